"""Clusters, token files and fill-in-the-middle against plain versions on odd inputs."""

import hashlib
import random
import re
import uuid
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from countloom.llm import centroids, fim, queries, tokenfile
from countloom.storage import scratch_path

from . import brute

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ROWS = brute.odd_rows() + [
    (100, "a<P>b c", "en", "a", 0),
    (101, "<P", "en", "a", 0),
    (102, " <S < M> <", "en", "a", 0),
    (103, "日本 語 ab  é́\n\n", "en", "a", 0),
    (104, "\t\t", "en", "a", 0),
    (105, "<|endoftext|> it's x<|startoftext|>y 12 İı Σας'LL " + "q" * 500, "en", "a", 0),
    (106, "a b\u0085c ́ 𝒳𝒴 ﻿", "en", "a", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark, ROWS).repartition(5).cache()


# ---- fill-in-the-middle -------------------------------------------------------------------


def rearranged(doc_id, text, seed=42, rate=50, spm_rate=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("seed,rate,spm", [(42, 50, 80), (1, 100, 0), (2, 100, 100), (3, 100, 50)])
def test_fill_in_middle(docs, seed, rate, spm):
    made = fim.fill_in_middle(docs, fim.FimConfig(seed, rate, spm)).withColumn("restored", fim.restore(F.col("output"), F.col("form")))
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    want = [(r[0], *rearranged(r[0], r[1], seed, rate, spm), r[1] or "") for r in ROWS]
    assert sorted((tuple(r) for r in made.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def test_fill_in_middle_of_a_long_text(spark):
    """A text longer than a chunk, without any white space at all in its middle."""
    text = "ab é " * 300_000 + "x" * 100_000 + " \n end"
    rows = [(k, text, "en", "a", 0) for k in range(4)]
    found = fim.fill_in_middle(brute.frame(spark, rows), fim.FimConfig(rate=100)).collect()
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == rearranged(r.doc_id, text, 42, 100, 80)


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        matrix = fim.WaveletMatrix(symbols)
        at = np.arange(n + 1)
        for s in range(8):
            assert matrix.rank(s, at).tolist() == [0, *np.cumsum(symbols == s).tolist()]


def test_no_sentinel_arises_at_a_seam(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("<PSM> ") for _ in range(rng.randrange(12))), "en", "a", 0) for k in range(400)]
    made = fim.fill_in_middle(brute.frame(spark, rows), fim.FimConfig(rate=100))
    found = made.select("doc_id", fim.restore(F.col("output"), F.col("form")).alias("t")).collect()
    assert {r.doc_id: r.t for r in found} == {r[0]: r[1] for r in rows}


# ---- token files --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def config():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenfile.TokenFileConfig(tokenizers.path("word_bpe_49k.json"), kept_words=300, kept_pieces=200)


@pytest.fixture(scope="module")
def written(spark, docs, config):
    path = scratch_path(spark, "tokens-test")
    tokenfile.write_tokens(docs, path, config)
    return path


def encoded(config):
    """(id, ids) of every row by whole texts, in the order of the files."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(config.tokenizer)
    return [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids + [config.end_id]) for r in ROWS]


def test_words_split_together_have_the_ids_of_the_whole_library(config):
    """Words of a chunk are split at once: signs, forms with apostrophes, other letters, marks of special tokens and long words between them."""
    import random

    from tokenizers import Tokenizer

    rng, t = random.Random(4), Tokenizer.from_file(config.tokenizer)
    signs = "abcXYZ'sdmtlvre0123 <|endoftext|>\xe9\xc0\xdf\xf7\xd7\u0436\u4e2d\ufb01\x7f.-,!\u0130\u017f" + "".join(map(chr, range(33, 127)))
    texts = [" ".join("".join(rng.choices(signs, k=rng.choice([1, 2, 5, 9, 70]))) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    data = [text.encode() for text in [*texts, "", "IT'S we'll", "x" * 200 + " it's"]]
    encoder = tokenfile.WordEncoder(config)
    for at in range(0, len(data), 20):
        some = data[at : at + 20]
        bounds = np.cumsum([0, *map(len, some)])
        ids = encoder.encode(np.frombuffer(b"".join(some), np.uint8), bounds)
        want = [t.encode(d.decode(), add_special_tokens=False).ids + [config.end_id] for d in some]
        assert [np.frombuffer(i, "<u4").tolist() for i in ids] == want


def test_token_files_hold_the_ids(spark, written, config):
    found = tokenfile.read_documents(spark, written).orderBy("start").collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in found), key=repr) == sorted(encoded(config), key=repr)
    assert [r.doc_id is None for r in found] == sorted(r.doc_id is None for r in found)
    ids = [r.doc_id for r in found if r.doc_id is not None]
    assert ids == sorted(ids)
    position = 0
    for r in found:
        assert (r.start, r.n_tokens) == (position, len(r.ids))
        position += r.n_tokens
    sums = {(r.start, r.ids_crc32) for r in tokenfile.with_crc32(tokenfile.read_documents(spark, written)).collect()}
    assert sums == {(r.start, zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())) for r in found}


def test_token_files_are_read_selectively(spark, written):
    whole = [i for r in tokenfile.read_documents(spark, written).orderBy("start").collect() for i in r.ids]
    for first, count in ((0, 10), (777, 3000), (len(whole) - 5, 5), (len(whole) - 5, 50), (3, 0)):
        rows = tokenfile.read_span(spark, written, first, count).orderBy("start").collect()
        assert [i for r in rows for i in r.ids] == whole[first : first + count]
        assert not rows or rows[0].start == first
    some = tokenfile.read_documents(spark, written, 20, 30)
    assert sorted(r.doc_id for r in some.collect()) == list(range(20, 31))
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,20)" in plan
    assert "ids:" not in tokenfile.read_metadata(spark, written)._jdf.queryExecution().executedPlan().toString()
    total = tokenfile.manifest(spark, written).agg(F.sum("part_tokens"), F.sum("n_docs")).first()
    assert tuple(total) == (len(whole), len(ROWS))


def test_token_file_format(spark, config, tmp_path):
    """Encodings, row groups, page sizes and page indexes, as another reader sees them."""
    rng = random.Random(2)
    rows = [(k, brute.prose(rng, 200, 3000), "en", "a", 0) for k in range(3000)]
    small = tokenfile.TokenFileConfig(config.tokenizer, row_group_bytes=256 << 10, page_bytes=8 << 10, page_rows=100)
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    tokenfile.write_tokens(brute.frame(spark, rows), path, small)
    files = list((tmp_path / path / "tokens").glob("*.parquet"))
    groups = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                name = column.path_in_schema
                assert column.has_offset_index and column.has_column_index
                if name.startswith("ids"):
                    assert "RLE_DICTIONARY" in column.encodings
                else:
                    assert "DELTA_BINARY_PACKED" in column.encodings and column.dictionary_page_offset is None
    assert groups > len(files)


def test_words_split_here_have_the_ids_of_the_library(config):
    """Contractions, signs, digits, Latin letters and everything beyond them, in random words."""
    encoder, rng = tokenfile.WordEncoder(config), random.Random(1)
    assert encoder.latin
    signs = "abcDEF''''stvedlm019 .,!\xdf\xc4\xd6\xff\xde\xfe\xf0\xf7\xd7\xe9\xc9<|>\u0301\u0130 \x1c\x85\u03c3\u03a3\u65e5\xaa\xba\xb2\xb5\u200b\n"
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(30)))
        data = np.frombuffer(text.encode(), np.uint8)
        ids = np.frombuffer(encoder.encode(data, np.array([0, len(data)]))[0], "<u4").tolist()
        assert ids == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [1], repr(text)


def test_no_documents_no_tokens(spark, config):
    path = scratch_path(spark, "tokens-none")
    tokenfile.write_tokens(brute.frame(spark, []), path, config)
    assert tokenfile.read_documents(spark, path).count() == 0 and tokenfile.read_metadata(spark, path).count() == 0


# ---- clusters -----------------------------------------------------------------------------


def clustered(vectors, k, rounds=10):
    """(vec_id, cluster, distance, cluster inertia, inertia, digest) by comparing everything with everything."""
    kept = [(i, [int(np.floor(1024 * float(c))) for c in v]) for i, v in vectors if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in kept)
    centroids = [v for _, v in order[:k]]
    x = np.array([v for _, v in kept], dtype=object)

    def assign():
        d = np.array([[int(((v - np.array(c, dtype=object)) ** 2).sum()) for c in centroids] for v in x])
        return [(min(range(len(centroids)), key=lambda c: (row[c], c)), min(row)) for row in d.tolist()]

    for _ in range(rounds):
        a = [c for c, _ in assign()]
        for c in range(len(centroids)):
            members = [v for v, m in zip(x, a) if m == c]
            if members:
                centroids[c] = [int(s) // len(members) for s in np.sum(members, axis=0)]
    final = assign()
    inertia = {c: sum(d for m, d in final if m == c) for c in range(len(centroids))}
    return [
        (i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for (i, _), (c, d) in zip(kept, final)
    ]


def vector_rows():
    rng = random.Random(9)
    rows = [(k, [round(rng.gauss(k % 5, 0.3), 3) for _ in range(64)]) for k in range(150)]
    rows += [(k, [float(rng.randrange(2))] + [0.0] * 63) for k in range(200, 240)]
    rows += [(300, [float("nan")] * 64), (301, [float("inf")] + [0.0] * 63), (302, [1.0] * 63), (303, [None] + [1.0] * 63), (304, None), (305, [])]
    rows += [(None, [0.5] * 64), (7, rows[7][1]), (7, [0.25] * 64), (306, [-1000.25] * 64)]
    return rows


@pytest.mark.parametrize("k,leaf", [(8, 2), (8, 1), (30, 3), (500, 4)])
def test_clusters(spark, k, leaf):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("cluster", "distance", "n", "v", "inertia"):
        df = df.withColumn(name, F.lit("extra"))
    found = centroids.cluster(df.repartition(4), centroids.ClusterConfig(clusters=k, leaf=leaf))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(clustered(rows, k), key=repr)


def test_tree_finds_the_nearest_and_the_smaller_number_on_ties():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60):
        points = rng.integers(-3, 4, (n, 5))
        points = np.concatenate([points, points[: n // 2]])
        x = rng.integers(-4, 5, (500, 5))
        tree = centroids.build_tree(points, 2)
        number, squared = centroids.nearest(tree, x)
        d = ((x[:, None] - points[None]) ** 2).sum(2)
        assert (squared == d.min(1)).all() and (number == d.argmin(1)).all()


def test_tree_prunes():
    """Far groups of centroids are not compared."""
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(0, 50, (64, 8)) + 100_000 * g for g in range(8)])
    tree = centroids.build_tree(points, 4)
    visited = []

    class Counted(list):
        def __getitem__(self, at):
            visited.append(at)
            return super().__getitem__(at)

    centroids.nearest({"nodes": Counted(tree["nodes"]), "centroids": points}, points[:1])
    assert len(visited) < len(tree["nodes"]) / 4


def test_no_vectors(spark):
    assert centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_clusters_of_huge_components(spark):
    rows = [(k, [1e300 if k % 2 else -1e300] * 64) for k in range(20)]
    found = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), centroids.ClusterConfig(clusters=2))
    assert len(found.collect()) == 20


def test_registered():
    assert {"op11_centroid_clusters", "op12_token_files", "op13_fill_in_middle"} <= set(queries.QUERIES)
