"""Mixing sources to target weights, in DataFrame functions only.

The words of each source form one stream (documents in the order of a hash), read up to ``cap`` = 2 times and cut into blocks of fixed length;
the last block may be shorter. A source's target in words becomes a number of blocks. The mix is a row of output slots in
shards of ``shard_slots``:

1. Every slot draws a source with probability proportional to the numbers of blocks, so the counts of a shard are multinomial.
2. The running count of a source over the shards numbers its slots. Draws beyond a source's number of blocks are handed to the
   sources that were drawn too rarely, so that totals are met exactly.
3. Slot number j of a source takes block p(j), where p is a pseudorandom permutation of the first pass over the stream and, beyond it, one of
   the second (swap-or-not rounds, which work for any size and need no table).
4. Slots and documents meet in a join on (source, block).

As a block is taken once at most and the stream holds each word twice, no document exceeds twice its size. Choices are
hashes, so reruns agree. Running sums are taken over ranges, never over a source in one task; the tables of sources hold one
row per source.

Defined results: texts without words (or null) take nothing. A null source is a source, the last in order. Rows equal in all read columns are separate documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countloom.functions.ranking import with_running
from countloom.llm.tables import DOCUMENT_COLUMNS, WORD, word_slice
from countloom.storage import materialise

_BINS = 4096
_ROUNDS = 12
PASSES = 2


@dataclass(frozen=True)
class MixConfig:
    """``weights`` repeat over the sources in order; together they get ``share`` times all words."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    block_words: int = 128
    shard_slots: int = 4096
    seed: int = 7


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, source, size)."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sizes: DataFrame, config: MixConfig) -> DataFrame:
    """(source, place, source_size, target, blocks, first_pass, full): one row per source.

    With a common level, a source gets weight * level words but at most twice its size. In order of size / weight the
    sources that reach their bound come first, and the level follows from the words and weights that are left at the first
    one that does not. This is where resharing the excess by weight ends.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in config.weights])
    per = per.withColumn("place", F.row_number().over(order) - 1)
    per = per.withColumn("weight", F.element_at(weights, (F.col("place") % len(config.weights) + 1).cast("int")))
    bound = (F.col("source_size") * PASSES).cast("double")
    per = per.withColumn("bound", bound).withColumn("ratio", F.col("bound") / F.col("weight"))
    by_ratio = everything.orderBy("ratio", "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    wanted = F.sum("source_size").over(everything) * F.lit(config.share)
    per = per.withColumn("level", (wanted - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    free = F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "place", "level"))
    per = per.withColumn("level", F.min(free).over(everything)["level"])
    per = per.withColumn("target", F.least("bound", F.coalesce(F.col("weight") * F.col("level"), F.col("bound"))))
    block = config.block_words
    per = per.withColumn("full", F.floor(F.col("source_size") * PASSES / block))
    rest = F.col("source_size") * PASSES - F.col("full") * block
    all_blocks = (rest > 0) & (F.col("target") >= F.col("full") * block + rest / 2)
    blocks = F.when(all_blocks, F.col("full") + 1).otherwise(F.least("full", F.round(F.col("target") / block).cast("long")))
    first_pass = F.least("full", F.ceil(F.col("source_size") / block))
    return per.select(
        "source", "place", "source_size", "target", blocks.alias("blocks"), first_pass.alias("first_pass"), "full"
    )


def shuffled(x: Column, n: Column, key: Column, seed: int) -> Column:
    """Image of x under a pseudorandom permutation of 0 to n - 1.

    In each round x may trade places with its mirror image; both sides decide by the same hash.
    """

    def turn(at: Column, k: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(seed), key, k), n) - at, n)
        return F.when(F.pmod(F.xxhash64(F.lit(seed + 1), key, k, F.greatest(at, mirror)), F.lit(2)) == 1, mirror).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), x.cast("long"), turn)


def slots(goals: DataFrame, config: MixConfig) -> DataFrame:
    """(shard, place, number, block): every output slot with its source and the block it takes."""
    spark = goals.sparkSession
    total = goals.agg(F.sum("blocks")).first()[0] or 0
    everything = Window.partitionBy(F.lit(0))
    upto = F.sum("blocks").over(everything.orderBy("place"))
    ranges = goals.select("place", (upto - F.col("blocks")).alias("low"), upto.alias("high")).filter("low < high")
    # Bins turn the search for the range of a draw into an equality join; there are at most _BINS + sources rows.
    width = max(1, -(-total // _BINS))
    bins = ranges.withColumn(
        "bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width)))
    )
    bins = materialise(bins, "bins")
    drawn = spark.range(total).select(
        F.floor(F.col("id") / config.shard_slots).alias("shard"),
        F.pmod(F.xxhash64(F.lit(config.seed), "id"), F.lit(max(total, 1))).alias("u"),
    )
    drawn = drawn.withColumn("bin", F.floor(F.col("u") / width)).join(bins, "bin").filter("low <= u AND u < high")
    counts = drawn.groupBy("shard", "place").agg(F.count(F.lit(1)).alias("n"))
    run = with_running(counts, ["place"], [F.col("shard")], {"upto": F.col("n").cast("double")})
    quota = goals.select("place", "blocks")
    run = run.join(quota, "place").withColumn("before", (F.col("upto") - F.col("n")).cast("long"))
    take = F.greatest(F.lit(0).cast("long"), F.least("n", F.col("blocks") - F.col("before")))
    run = materialise(run.select("shard", "place", "n", "before", take.alias("take")), "draws")
    own = run.filter("take > 0").select(
        "shard", "place", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("take") - 1)).alias("number")
    )
    # Draws beyond the quota, one row each and numbered, meet the missing ones by number.
    over = run.filter("n > take").select("shard", "place", (F.col("n") - F.col("take")).alias("over"))
    over = with_running(over, [], [F.col("shard"), F.col("place")], {"upto": F.col("over").cast("double")})
    last = F.col("upto").cast("long")
    spare = over.select("shard", F.explode(F.sequence(last - F.col("over"), last - 1)).alias("unit"))
    met = run.groupBy("place").agg(F.sum("take").alias("met"))
    short = quota.join(met, "place", "left").select(
        "place", F.coalesce("met", F.lit(0).cast("long")).alias("met"), (F.col("blocks") - F.coalesce("met", F.lit(0))).alias("lack")
    )
    short = short.withColumn("end", F.sum("lack").over(everything.orderBy("place"))).filter("lack > 0")
    missing = short.select(
        "place", "met", (F.col("end") - F.col("lack")).alias("begin"), F.explode(F.sequence(F.col("end") - F.col("lack"), F.col("end") - 1)).alias("unit")
    )
    refill = spare.join(missing, "unit").select("shard", "place", (F.col("met") + F.col("unit") - F.col("begin")).alias("number"))
    numbered = own.unionByName(refill).join(goals.select("place", "first_pass", "full"), "place")
    second = F.col("full") - F.col("first_pass")
    # The place joins the key, so every source and pass has its own permutation.
    block = (
        F.when(F.col("number") < F.col("first_pass"), shuffled(F.col("number"), F.col("first_pass"), F.col("place") * 2, config.seed))
        .when(
            F.col("number") < F.col("full"),
            F.col("first_pass") + shuffled(F.col("number") - F.col("first_pass"), second, F.col("place") * 2 + 1, config.seed),
        )
        .otherwise(F.col("number"))
    )
    return numbered.select("shard", "place", "number", block.alias("block"))


@dataclass
class Mix:
    """``documents``: doc_id, text_key, source, size, source_size, target, place, offset, taken.

    ``slots``: the output, as above. ``pieces``: (place, offset, doc_id, text_key, pass, block, start, words), the words of every taken block by
    document, ``start`` counted in words of the document.
    """

    documents: DataFrame
    slots: DataFrame
    pieces: DataFrame


def mix(docs: DataFrame, config: MixConfig = MixConfig()) -> Mix:
    sizes = materialise(sized(docs), "sizes")
    goals = materialise(targets(sizes, config), "targets")
    chosen = materialise(slots(goals, config), "slots")
    placed = with_running(
        sizes.filter("size > 0"),
        ["source"],
        [F.xxhash64(F.lit(config.seed), "doc_id", "text_key"), F.col("doc_id"), F.col("text_key")],
        {"upto": F.col("size").cast("double")},
    ).select("doc_id", "text_key", "source", "size", (F.col("upto").cast("long") - F.col("size")).alias("offset"))
    known = goals.withColumnRenamed("source", "_source")
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = materialise(placed, "placed")
    block = config.block_words
    passes = placed.withColumn("pass", F.explode(F.array(*[F.lit(k) for k in range(PASSES)])))
    begin = F.col("offset") + F.col("pass") * F.col("source_size")
    passes = passes.withColumn("begin", begin).withColumn("end", F.col("begin") + F.col("size"))
    cut = passes.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    low, high = F.greatest("begin", F.col("block") * block), F.least("end", (F.col("block") + 1) * block)
    cut = cut.select(
        "place", "offset", "doc_id", "text_key", "pass", "block", (low - F.col("begin")).alias("start"), (high - low).alias("words")
    )
    pieces = cut.join(chosen.select("place", "block"), ["place", "block"])
    used = pieces.groupBy(F.col("place").alias("_place"), F.col("offset").alias("_offset")).agg(F.sum("words").alias("taken"))
    with_words = placed.join(used, (F.col("place") == F.col("_place")) & (F.col("offset") == F.col("_offset")), "left")
    columns = ["doc_id", "text_key", "source", "size", "source_size", "target", "place", "offset"]
    nothing = F.lit(0).cast("long")
    full = with_words.select(*columns, F.coalesce("taken", nothing).alias("taken"))
    empty = sizes.filter("size = 0").join(known, F.col("source").eqNullSafe(F.col("_source")))
    empty = empty.withColumn("offset", F.lit(None).cast("long")).select(*columns, nothing.alias("taken"))
    return Mix(full.unionByName(empty), chosen, pieces)


def mixed_documents(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The mix as documents: each row is a maximal run of taken words of one document and pass, with its lang and source.

    A document taken whole in a pass gives its text unchanged; one that is taken twice gives two rows.
    """
    found = mix(docs, config).pieces
    one = Window.partitionBy("place", "offset", "pass").orderBy("block")
    marked = found.withColumn("run", F.sum((F.col("block") - F.lag("block", 1, -1).over(one) > 1).cast("int")).over(one))
    runs = marked.groupBy("place", "offset", "pass", "run", "doc_id", "text_key").agg(
        F.min("start").alias("_start"), F.sum("words").alias("_words")
    )
    runs = runs.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_start", "_words")
    rows = docs.select(*DOCUMENT_COLUMNS).withColumn("_row_key", F.xxhash64(F.col("text").cast("string")))
    rows = rows.dropDuplicates(["doc_id", "_row_key"])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_row_key") == F.col("_key"))
    joined = rows.join(runs, same)
    kind = docs.schema["n_chars"].dataType
    out = joined.withColumn("text", word_slice(F.col("_start"), F.col("_words")))
    return out.withColumn("n_chars", F.length("text").cast(kind)).select(*DOCUMENT_COLUMNS)
