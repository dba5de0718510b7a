"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact confirmation.

1. Every text becomes its set of distinct word shingles and a MinHash signature. Texts with
   equal sets form one class, so exact copies cost one row from here on.
2. Signatures are cut into bands; classes that agree in a band share a bucket.
3. A bucket never becomes all of its pairs. First every member is compared with one leader of its bucket, and
   linked members fall into components. Afterwards only pairs of different components are left; all of these
   are compared, in blocks of signatures of which only survivors leave the task, so no link is
   lost to a cap. Pairs within one component cannot change the result.
4. A compared pair is first held against its set sizes: the similarity is at most smaller / larger, so pairs
   of too different sizes go at once and without error. Then it is looked at in batches of signature values. With a uniform prior, the
   posterior of the similarity after m of n agreements is Beta(m + 1, n - m + 1); a pair whose posterior
   probability of reaching the threshold is below ``miss`` is pruned.
5. Survivors are confirmed by the full shingle sets.

Rows per step grow with the documents; only counts reach the driver. Every loop continues from tables written to
the shared checkpoint folder.

Defined results: a text without words (or null) has an empty set and links with nothing. A null id never names a component
that has another id; a component of null ids only has a null component id. Rows that repeat an id and text are all returned.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.sieve import split_by_ids
from countloom.llm.tables import text_key, texts
from countloom.llm.text import BASE, CHUNK_BYTES, hash_runs, mix, rolling, word_chunks
from countloom.storage import materialise

_PRIME_SEED = 23
_SHORT_BASE = np.uint64(int(BASE) + 2)


@dataclass(frozen=True)
class NearDupConfig:
    """At similarity 0.75, 32 bands of 4 values miss a pair with probability 6e-6.

    ``extra`` values beyond the bands only serve the sequential comparison. Each value is kept with 16 bits, which
    can only make a pair look more alike.

    ``percent``: linked if 100 * intersection >= percent * union. ``miss``: posterior probability below
    which a pair is pruned, after every ``batch`` signature values.
    """

    shingle: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    extra: int = 384
    batch: int = 32
    miss: float = 1e-6
    block: int = 256

    @property
    def values(self) -> int:
        return self.bands * self.rows + self.extra


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text of the chunk, sorted distinct shingle hashes, offsets per text) of a string column.

    A text with fewer words than ``width`` has its whole word sequence as its one shingle.
    """
    for chunk in word_chunks(column, lower=True):
        counts, owner = chunk.counts, chunk.text_of_word()
        grams = rolling(chunk.hash, width)
        whole = owner[: len(grams)] == owner[width - 1 :][: len(grams)] if len(grams) else np.zeros(0, bool)
        values, of = grams[whole], owner[: len(grams)][whole]
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            picked = np.isin(owner, short)
            values = np.concatenate([values, hash_runs(chunk.hash[picked], counts[short], _SHORT_BASE)])
            of = np.concatenate([of, short])
        order = np.lexsort((values, of))
        values, of = values[order], of[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
        values, of = values[fresh], of[fresh]
        yield chunk.first, values, np.searchsorted(of, np.arange(chunk.last - chunk.first + 1))


def set_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 128-bit key per set, as two columns; sets must not be empty."""
    begins = offsets[:-1]
    sizes = np.diff(offsets).astype(np.uint64)
    one = mix(np.add.reduceat(mix(values + np.uint64(1)), begins) + sizes)
    two = mix(np.add.reduceat(mix(values ^ BASE), begins) ^ (sizes << np.uint64(32)))
    return np.stack([one, two], axis=1)


def signatures(values: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """MinHash values of sets that are not empty, the low 16 bits of each."""
    rng = np.random.default_rng(_PRIME_SEED)
    scale = rng.integers(1, 2**62, size, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**62, size, dtype=np.int64).astype(np.uint64)
    out = np.empty((len(offsets) - 1, size), dtype=np.uint16)
    begins = offsets[:-1]
    for k in range(size):
        hashed = ((values ^ shift[k]) * scale[k] >> np.uint64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(hashed, begins) & np.uint32(0xFFFF)
    return out


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def describe(docs: DataFrame, config: NearDupConfig) -> DataFrame:
    """(doc_id, text_key, n_shingles, key, sig) per row; key and sig are null for an empty set."""

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            ids, keys = batch.column(0), batch.column(2)
            for first, values, offsets in shingle_sets(batch.column(1), config.shingle):
                n = len(offsets) - 1
                sizes = np.diff(offsets)
                full = np.flatnonzero(sizes)
                key = sig = pa.nulls(n, pa.binary())
                if len(full):
                    dense = np.append(offsets[:-1][full], offsets[-1])
                    at = np.full(n, -1)
                    at[full] = np.arange(len(full))
                    index = pa.array(at, mask=at < 0)
                    key = _fixed(set_keys(values, dense)).take(index)
                    sig = _fixed(signatures(values, dense, config.values)).take(index)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, n), keys.slice(first, n), pa.array(sizes.astype(np.int64)), key, sig],
                    names=["doc_id", "text_key", "n_shingles", "key", "sig"],
                )

    rows = texts(docs).select("doc_id", "text", text_key().alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, key binary, sig binary")


def full_sets(docs: DataFrame, wanted: DataFrame, config: NearDupConfig) -> DataFrame:
    """(key, items) of the classes in ``wanted`` (doc_id, text_key, key), from their texts."""

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            for first, values, offsets in shingle_sets(batch.column(1), config.shingle):
                items = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(offsets) - 1), items], names=["key", "items"]
                )

    # A null id may meet the id -1 here: with equal texts either row gives the set.
    place = F.coalesce("doc_id", F.lit(-1)).alias("doc_id")
    wanted = materialise(wanted.select(place, "text_key", "key"), "wanted")
    some, _ = split_by_ids(texts(docs).select(place, "text"), wanted)
    rows = some.withColumn("text_key", text_key())
    picked = rows.join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    return picked.select("key", "text").mapInArrow(run, "key binary, items array<long>")


def least_matches(config: NearDupConfig) -> list[tuple[int, int]]:
    """(n, m): after n values a pair with fewer than m agreements is pruned.

    P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m) under the uniform prior.
    """
    t, out = config.percent / 100, []
    for n in [*range(config.batch, config.values, config.batch), config.values]:
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= config.miss:
                break
            m += 1
        out.append((n, m))
    return out


def survivors(pairs: DataFrame, sigs: DataFrame, config: NearDupConfig) -> DataFrame:
    """The pairs (a, b) that sequential comparison of their signatures does not prune."""
    steps = least_matches(config)

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            left, right = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(-1, config.values)
                for k in (2, 3)
            )
            alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
            for n, least in steps:
                matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
                keep = matches >= least
                alive, matches, done = alive[keep], matches[keep], n
            index = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(index) for k in (0, 1)], names=["a", "b"])

    one = sigs.select(F.col("key").alias("a"), F.col("sig").alias("sig_a"), F.col("size").alias("size_a"))
    two = sigs.select(F.col("key").alias("b"), F.col("sig").alias("sig_b"), F.col("size").alias("size_b"))
    near = F.lit(100) * F.least("size_a", "size_b") >= F.lit(config.percent) * F.greatest("size_a", "size_b")
    both = pairs.join(one, "a").join(two, "b").filter(near).select("a", "b", "sig_a", "sig_b")
    return both.mapInArrow(run, "a binary, b binary")


def confirmed(pairs: DataFrame, sets: DataFrame, config: NearDupConfig) -> DataFrame:
    """The pairs whose full sets reach the threshold, with both sizes' ``shared`` and ``united``."""
    one = sets.select(F.col("key").alias("a"), F.col("items").alias("_one"))
    two = sets.select(F.col("key").alias("b"), F.col("items").alias("_two"))
    shared = F.size(F.array_intersect("_one", "_two")).cast("long")
    joined = pairs.join(one, "a").join(two, "b")
    counted = joined.select("a", "b", shared.alias("shared"), (F.size("_one") + F.size("_two")).alias("_sum"))
    return counted.select("a", "b", "shared", (F.col("_sum") - F.col("shared")).alias("united")).filter(
        F.lit(100) * F.col("shared") >= F.lit(config.percent) * F.col("united")
    )


def components(links: DataFrame) -> DataFrame:
    """(key, comp) of every linked key: the smallest key reachable over ``links`` (a, b).

    Every round takes the least label of the neighbours and then follows the label's own label, so
    chains shorten by doubling.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "links")
    labels = materialise(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["key"]).groupBy(both["a"].alias("key")).agg(F.min("comp").alias("near"))
        spread = labels.join(near, "key").select("key", F.least("comp", "near").alias("next"), "comp")
        above = labels.select(F.col("key").alias("next"), F.col("comp").alias("jump"))
        moved = spread.join(above, "next", "left").select(
            "key", F.least("next", F.coalesce("jump", "next")).alias("comp"), F.col("comp").alias("old")
        )
        moved = materialise(moved, "labels")
        labels = moved.select("key", "comp")
        if moved.filter(F.col("comp") != F.col("old")).isEmpty():
            return labels


def star_pairs(members: DataFrame) -> DataFrame:
    """(a, b): every member of a bucket with the bucket's leader.

    The leader is the member with the most company over all its buckets, which in a group of edited copies
    is close to the original.
    """
    leaders = members.groupBy("band").agg(F.max(F.struct("company", "key")).alias("top"))
    joined = members.join(leaders.select("band", F.col("top.key").alias("leader")), "band").filter(F.col("key") != F.col("leader"))
    return joined.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct()


def blocks(members: DataFrame, sigs: DataFrame, block: int) -> DataFrame:
    """(band, slot, part, parts, outside, items): the buckets with several components, cut into parts of about ``block`` members.

    ``outside`` marks the members that are not in the bucket's largest component.
    """
    sizes = members.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    opened = (
        sizes.groupBy("band")
        .agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("rows"))
        .filter(F.col("top.n") < F.col("rows"))
        .select("band", F.col("top.comp").alias("major"), F.ceil(F.col("rows") / block).alias("parts"))
    )
    there = members.join(opened, "band").join(sigs, "key")
    there = there.withColumn("part", F.pmod(F.xxhash64("key"), "parts")).withColumn("outside", F.col("comp") != F.col("major"))
    return there.groupBy("band", "slot", "part", "parts").agg(
        F.max("outside").alias("outside"), F.collect_list(F.struct("key", "comp", "outside", "size", "sig")).alias("items")
    )


def block_survivors(cut: DataFrame, config: NearDupConfig) -> DataFrame:
    """The pairs (a, b) of different components that share a bucket and are not pruned.

    Whole blocks of signatures are compared in a task, so rows are made for survivors only. A pair that shares
    several buckets comes from the first of them.
    """
    steps = least_matches(config)

    def unpack(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        items = column[row].values
        sig = np.frombuffer(b"".join(items.field("sig").to_pylist()), dtype=np.uint16).reshape(-1, config.values)
        comp = np.array(items.field("comp").to_pylist(), dtype=object)
        outside, size = (items.field(name).to_numpy(zero_copy_only=False) for name in ("outside", "size"))
        return np.array(items.field("key").to_pylist(), dtype=object), comp, outside, size, sig

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            one, two = [], []
            for row in range(batch.num_rows):
                slot = batch.column(0)[row].as_py()
                same = batch.column(1)[row].as_py()
                key_a, comp_a, out_a, size_a, sig_a = unpack(batch.column(2), row)
                key_b, comp_b, out_b, size_b, sig_b = (key_a, comp_a, out_a, size_a, sig_a) if same else unpack(batch.column(3), row)
                wanted = (comp_a[:, None] != comp_b[None, :]) & (out_a[:, None] | out_b[None, :])
                small, large = np.minimum(size_a[:, None], size_b[None, :]), np.maximum(size_a[:, None], size_b[None, :])
                wanted &= 100 * small >= config.percent * large
                if same:
                    wanted = np.triu(wanted, 1)
                left, right = np.nonzero(wanted)
                matches, done = np.zeros(len(left), np.int64), 0
                for n, least in steps:
                    matches = matches + (sig_a[left, done:n] == sig_b[right, done:n]).sum(axis=1)
                    keep = matches >= least
                    left, right, matches, done = left[keep], right[keep], matches[keep], n
                before = slot * config.rows
                if before and len(left):
                    agree = (sig_a[left, :before] == sig_b[right, :before]).reshape(len(left), slot, config.rows).all(axis=2)
                    fresh = ~agree.any(axis=1)
                    left, right = left[fresh], right[fresh]
                one.extend(key_a[left])
                two.extend(key_b[right])
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.binary()), pa.array(two, pa.binary())], names=["a", "b"])

    alone = cut.filter("outside").select("slot", F.lit(True).alias("same"), "items", F.col("items").alias("others"))
    many = cut.filter("parts > 1")
    other = many.select("band", F.col("part").alias("part_2"), F.col("outside").alias("outside_2"), F.col("items").alias("others"))
    crossed = many.join(other, "band").filter((F.col("part") < F.col("part_2")) & (F.col("outside") | F.col("outside_2")))
    alone = alone.withColumn("others", F.slice("others", 1, 0))
    rows = alone.unionByName(crossed.select("slot", F.lit(False).alias("same"), "items", "others"))
    return rows.mapInArrow(run, "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


@dataclass
class NearDups:
    """``documents``: one row per document; ``links``: confirmed (a, b, shared, united) between class keys."""

    documents: DataFrame
    links: DataFrame


def near_duplicates(docs: DataFrame, config: NearDupConfig = NearDupConfig()) -> NearDups:
    """Class, component and representative of every document.

    ``documents``: doc_id, text_key, key (of the class), n_shingles, component_id (smallest id reachable), first_text (smallest text key of
    the component), kept (the id is its component's).
    ``links`` holds the links that decide the components, not all within one.
    """
    rows = materialise(describe(docs, config), "shingled")
    classes = (
        rows.filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min("doc_id").alias("label"), F.min("text_key").alias("first_text"), F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size"))
    )
    classes = materialise(classes, "classes")
    sigs = classes.select("key", "sig", "size")
    width = config.rows * 2
    band = F.expr(f"transform(sequence(0, {config.bands - 1}), i -> xxhash64(i, substring(sig, i * {width} + 1, {width})))")
    bands = sigs.select("key", F.posexplode(band).alias("slot", "band"))
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialise(bands.join(sizes, "band"), "buckets")
    company = materialise(shared.groupBy("key").agg(F.sum("n").alias("company")), "company")
    wanted = classes.join(company, "key").select("key", F.col("row.doc_id").alias("doc_id"), F.col("row.text_key").alias("text_key"))
    sets = materialise(full_sets(docs, wanted, config), "sets")
    placed = shared.select("band", "slot", "key")

    stars = materialise(survivors(star_pairs(placed.join(company, "key")), sigs, config), "survivors")
    stars = materialise(confirmed(stars, sets, config), "links")
    comps = components(stars)
    members = materialise(placed.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key")), "members")
    cut = materialise(blocks(members, sigs, config.block), "blocks")
    rest = materialise(block_survivors(cut, config), "survivors")
    links = stars.unionByName(confirmed(rest, sets, config))
    links = materialise(links, "links")
    comps = components(links)
    labels = classes.select("key", "label", "first_text")
    joined = labels.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    least = joined.groupBy("comp").agg(F.min("label").alias("component_id"), F.min("first_text").alias("first_text"))
    labels = joined.select("key", "comp").join(least, "comp").select("key", "component_id", "first_text")
    out = rows.select("doc_id", "text_key", "n_shingles", "key").join(labels, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "text_key", "key", "n_shingles", component.alias("component_id"), "first_text")
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return NearDups(out, links)


def keep_one(docs: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """``docs`` with one document per component; of rows equal in id and text one stays.

    Of a component without ids the row with the smallest hash of its text stays.
    """
    # The null of an id is a key of its own, so the join and the removal of repeats share one shuffle.
    place = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull()]
    kept = near_duplicates(docs, config).documents.filter("kept AND (doc_id IS NOT NULL OR key IS NULL OR text_key = first_text)")
    kept = kept.select(place[0].alias("_id"), place[1].alias("_no_id"), F.col("text_key").alias("_row_key"))
    keys = ["_id", "_no_id", "_row_key"]
    keyed = docs.withColumns({"_id": place[0], "_no_id": place[1], "_row_key": F.xxhash64(F.col("text").cast("string"))})
    return keyed.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys)
