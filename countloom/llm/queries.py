"""Registered queries of the subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm import centroids, fim, media, mixing, neardup, packing, pictures, pii, quality, substring, suffixtree, tokenfile, toxicity, urllists
from countloom.llm.tables import documents
from countloom.storage import scratch_path


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(documents(spark, sf_dir))
    return found.documents.select("doc_id", "n_shingles", "component_id", "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(documents(spark, sf_dir), window=50)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = suffixtree.score_held_out(documents(spark, sf_dir), remainder=1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.classify(documents(spark, sf_dir), labels)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).drop("text_key")


def op7_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detect(documents(spark, sf_dir)))


def op8_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.judge(documents(spark, sf_dir), labels)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"
    )


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.documents.select("doc_id", "size", "source_size", "target", "taken")


def op4_url_list_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch days and list entries are derived from the pages: a host joins a list on a day given by its first page and may leave it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    start = F.lit("2020-01-01").cast("date")
    captures = pages.withColumn("fetched", F.date_add(start, (F.col("page_id") * 37 % 1500).cast("int")))
    hosts = pages.groupBy(urllists.host_of(F.col("url")).alias("domain")).agg(F.min("page_id").alias("first"))
    name = F.concat(F.lit("list_"), (F.col("first") % 3).cast("string"))
    joins = hosts.select(name.alias("list_name"), "domain", F.date_add(start, (F.col("first") * 53 % 1200).cast("int")).alias("day"), F.lit(True).alias("listed"))
    leaves = joins.filter("list_name <> 'list_0'").withColumns({"day": F.date_add("day", 200), "listed": F.lit(False)})
    found = urllists.evaluate(captures, joins.unionByName(leaves))
    return found.select("page_id", F.col("fetched").cast("string").alias("fetched"), F.array_join("lists", ",").alias("lists"))


def op2_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pictures of all pages; no table holds images, so they are drawn from the pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return media.image_copies(pictures.pictures(pages))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), centroids.ClusterConfig(clusters=8, rounds=10))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with the public word tokenizer, written, read back and summed up."""
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    tokenfile.write_tokens(documents(spark, sf_dir), path, tokenfile.TokenFileConfig(public_tokenizers.path("word_bpe_49k.json"), end_id=1))
    return tokenfile.with_crc32(tokenfile.read_documents(spark, path))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(documents(spark, sf_dir), fim.FimConfig(seed=42, rate=50, spm_rate=80))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def _clusters_sql(rounds: int = 10, clusters: int = 8) -> str:
    """The rounds written out one after the other."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""d{r} AS (SELECT rid, c, sum((x.v - k.v) * (x.v - k.v)) AS apart FROM x JOIN c{r} k USING (d) GROUP BY rid, c),
    a{r} AS MATERIALIZED (SELECT rid, c, apart FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY apart, c) = 1)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS (SELECT c, d, CAST(sum(v) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{r} JOIN x USING (rid) GROUP BY c, d),
    c{r + 1} AS MATERIALIZED (SELECT k.c, k.d, coalesce(CAST((s - ((s % n + n) % n)) // n AS BIGINT), k.v) AS v FROM c{r} k LEFT JOIN m{r} m ON m.c = k.c AND m.d = k.d)"""
            )
    return (
        """WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
    x AS MATERIALIZED (SELECT rid, unnest(range(64)) AS d, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS v FROM kept),
    first AS (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM kept QUALIFY c < """
        + f"{clusters}), c0 AS MATERIALIZED (SELECT c, d, v FROM first JOIN x USING (rid)), "
        + ", ".join(steps)
        + f""",
    digest AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c)
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(apart AS BIGINT) AS distance, CAST(sum(apart) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
           CAST(sum(apart) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN kept USING (rid) JOIN digest USING (c)"""
    )


QUERIES = {
    "op2_image_copies": op2_image_copies,
    "op4_url_list_asof": op4_url_list_asof,
    "op1_source_mixing": op1_source_mixing,
    "op8_risk_controlled_quality": op8_risk_controlled_quality,
    "op7_pii_crf": op7_pii_crf,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op3_toxicity_cnn": op3_toxicity_cnn,
    "op6_substring_dedup": op6_substring_dedup,
    "op9_minhash_neardup": op9_minhash_neardup,
    "op10_suffix_tree_lm": op10_suffix_tree_lm,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_token_files": op12_token_files,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op11_centroid_clusters": _clusters_sql(),
    "op13_fill_in_middle": r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                      regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
    n AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                 CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
    cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                        WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
    parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cut)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(text) AS restored_sha256 FROM parts""",
    "op4_url_list_asof": r"""
    WITH captures AS (
      SELECT page_id, DATE '2020-01-01' + CAST(page_id * 37 % 1500 AS INTEGER) AS fetched,
             nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host
      FROM pages),
    joins AS (
      SELECT concat('list_', CAST(min(page_id) % 3 AS VARCHAR)) AS list_name, host AS domain,
             DATE '2020-01-01' + CAST(min(page_id) * 53 % 1200 AS INTEGER) AS valid_from
      FROM captures WHERE host IS NOT NULL GROUP BY host),
    hits AS (
      SELECT DISTINCT page_id, fetched, list_name FROM captures c JOIN joins j
      ON (c.host = j.domain OR ends_with(c.host, '.' || j.domain))
      WHERE fetched >= valid_from AND (list_name = 'list_0' OR fetched < valid_from + 200))
    SELECT c.page_id, CAST(c.fetched AS VARCHAR) AS fetched, coalesce(string_agg(list_name, ',' ORDER BY list_name), '') AS lists
    FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id GROUP BY c.page_id, c.fetched"""
}
