"""Repeated passages: relative Lempel-Ziv parsing of documents against all earlier ones.

The reference blocks are the ``window``-word sequences of all documents, each at its first occurrence (smallest id).
A document is factored greedily against them: at a word where a block of an earlier document starts, the factor is
followed word by word for as long as that document continues alike. Where the factor ends, the windows that
cross its end are looked up as well, since they may start in another document. Factors of at least ``window``
words are the duplicate spans.

Looking up every window of every document would shuffle one row per word. Instead each window is filed
under its anchor, the least hash among its word 8-grams, which is the same in every copy of the window:

1. Consecutive windows with the same anchor form a run, about 20 windows long. Runs with equal words are equal in all
   their windows, so one row per run decides for them: every run that has a copy in an earlier document is a match.
2. Only the first occurrences of runs stay, and of these only the ones whose anchor also occurs in a different run:
   there the passages differ at an edge or an edit. They are expanded into single windows.
3. The matches of a document are parsed into factors, per document, over short lists of positions.

A row per run or expanded window is all that is shuffled; the size of a group of copies changes the number of rows in
proportion. Hashes compared across documents have 96 bits.

Defined results: a null or empty text has no words. Rows with a null id lose nothing and are no reference. Rows that repeat an id are
one document in different rows: they are no reference for each other. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.sieve import split_by_ids
from countloom.llm.tables import text_key, texts
from countloom.llm.text import BASE, Words, buffers, chunk_bounds, mix, powers, rolling, word_chunks
from countloom.storage import materialise

GRAM = 8
_SECOND = np.uint64(int(BASE) * 3 % 2**64)
_LOW = np.uint64((1 << 22) - 1)


class _Prefix:
    """Hashes of any word range of a chunk, from prefix sums."""

    def __init__(self, hashes: np.ndarray, base: np.uint64):
        n = len(hashes)
        inverse = np.uint64(pow(int(base), -1, 2**64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(base, n), out=self.sums[1:])
        self.back = powers(inverse, n + 1)

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((self.sums[last] - self.sums[first]) * self.back[first] + (last - first).astype(np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def window_runs(chunk: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, end) of the runs of windows with one anchor; positions count words of the chunk."""
    empty = np.zeros(0, np.int64)
    grams = rolling(chunk.hash, GRAM)
    span = window - GRAM + 1
    if len(grams) < span:
        return np.zeros(0, np.uint64), empty, empty
    if len(grams) > int(_LOW):
        raise ValueError(f"a text has more than {int(_LOW)} words")
    # The position in the low bits makes the leftmost of equal grams the least, in every copy alike.
    packed = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    least = _least(packed, span)
    anchor = (least & _LOW).astype(np.int64)
    owner = chunk.text_of_word()
    whole = owner[: len(least)] == owner[window - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return np.zeros(0, np.uint64), empty, empty
    breaks = np.ones(len(at), bool)
    breaks[1:] = (at[1:] != at[:-1] + 1) | (anchor[at][1:] != anchor[at][:-1]) | (owner[at][1:] != owner[at][:-1])
    first = at[breaks]
    last = at[np.append(np.flatnonzero(breaks)[1:], len(at)) - 1] + 1
    return grams[anchor[first]], first, last


def _int32(x: np.ndarray) -> pa.Array:
    return pa.array((x >> np.uint64(32)).astype(np.uint32).view(np.int32))


def runs(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, anchor, h, check, start, n): runs of ``n`` windows from word ``start``; h and check are of all their words."""

    def work(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            for chunk in word_chunks(batch.column(1), lower=False):
                anchor, first, last = window_runs(chunk, window)
                if not len(first):
                    continue
                row = np.searchsorted(chunk.offsets, first, "right") - 1
                ends = last + window - 1
                index = pa.array(row + chunk.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(index),
                        batch.column(2).take(index),
                        pa.array(anchor.view(np.int64)),
                        pa.array(_Prefix(chunk.hash, BASE).of(first, ends).view(np.int64)),
                        _int32(_Prefix(chunk.hash, _SECOND).of(first, ends)),
                        pa.array((first - chunk.offsets[row]).astype(np.int32)),
                        pa.array((last - first).astype(np.int32)),
                    ],
                    names=["doc_id", "text_key", "anchor", "h", "check", "start", "n"],
                )

    rows = texts(docs).filter("doc_id IS NOT NULL").select("doc_id", "text", text_key().alias("text_key"))
    return rows.mapInArrow(work, "doc_id long, text_key long, anchor long, h long, check int, start int, n int")


def single_windows(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, h, check, start) of every window in ``spans`` (doc_id, text_key, spans of start and n)."""

    def work(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            wanted = batch.column(3)
            for chunk in word_chunks(batch.column(1), lower=False):
                part = wanted.slice(chunk.first, chunk.last - chunk.first)
                flat = part.flatten()
                if not len(flat):
                    continue
                row = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy(zero_copy_only=False))
                start = flat.field("start").to_numpy().astype(np.int64)
                n = flat.field("n").to_numpy().astype(np.int64)
                owner = np.repeat(row, n)
                begin = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
                first = begin + chunk.offsets[owner]
                index = pa.array(owner + chunk.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(index),
                        batch.column(2).take(index),
                        pa.array(_Prefix(chunk.hash, BASE).of(first, first + window).view(np.int64)),
                        _int32(_Prefix(chunk.hash, _SECOND).of(first, first + window)),
                        pa.array(begin.astype(np.int32)),
                    ],
                    names=["doc_id", "text_key", "h", "check", "start"],
                )

    some, _ = split_by_ids(texts(docs), spans)
    rows = some.withColumn("text_key", text_key()).withColumnRenamed("doc_id", "_doc")
    rows = rows.dropDuplicates(["_doc", "text_key"])
    joined = rows.join(spans, (rows["_doc"] == spans["doc_id"]) & (rows["text_key"] == spans["text_key"])).select(
        "doc_id", "text", spans["text_key"], "spans"
    )
    return joined.mapInArrow(work, "doc_id long, text_key long, h long, check int, start int")


def matches(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, text_key, start, n, ref_doc, ref_start): ``n`` consecutive windows that an earlier document holds from ``ref_start``."""
    found = materialise(runs(docs, window), "runs")
    at = F.struct("doc_id", "start", "text_key", "n", "anchor")
    distinct = materialise(found.groupBy("h", "check").agg(F.min(at).alias("top"), F.count(F.lit(1)).alias("copies")), "first")
    first = distinct.select(
        "h", "check", "copies", F.col("top.doc_id").alias("ref_doc"), F.col("top.start").alias("ref_start")
    ).filter("copies > 1")
    whole = (
        found.join(first, ["h", "check"])
        .filter(F.col("doc_id") > F.col("ref_doc"))
        .select("doc_id", "text_key", "start", "n", "ref_doc", "ref_start")
    )
    # Anchors with different runs: only there can a first occurrence repeat windows of an earlier document.
    heads = distinct.select("h", "check", "copies", "top.*")
    contested = (
        heads.groupBy("anchor")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .filter("low < high")
        .select("anchor")
    )
    opened = heads.join(contested, "anchor").select("h", "check", "copies", "doc_id", "text_key", "start", "n")
    opened = materialise(opened, "contested")
    spans = opened.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    spans = materialise(spans, "spans")
    windows = materialise(single_windows(docs, spans, window), "windows")
    least = windows.groupBy("h", "check").agg(
        F.min(F.struct("doc_id", "start")).alias("top"), F.max("doc_id").alias("last")
    ).filter(F.col("last") > F.col("top.doc_id"))
    hits = (
        windows.join(least, ["h", "check"])
        .filter(F.col("doc_id") > F.col("top.doc_id"))
        .select("doc_id", "text_key", "start", F.lit(1).alias("n"), F.col("top.doc_id").alias("ref_doc"), F.col("top.start").alias("ref_start"))
    )
    # The same run may stand several times in its first document; what holds for one place holds for all.
    again = (
        found.join(opened.filter("copies > 1").select("h", "check", F.col("doc_id").alias("_d"), F.col("start").alias("_s"), F.col("text_key").alias("_k")), ["h", "check"])
        .filter((F.col("doc_id") == F.col("_d")) & ((F.col("start") != F.col("_s")) | (F.col("text_key") != F.col("_k"))))
        .select("doc_id", "text_key", "_s", "_k", "n", (F.col("start") - F.col("_s")).alias("shift"))
    )
    head_hits = hits.select(F.col("doc_id").alias("_hd"), F.col("text_key").alias("_hk"), F.col("start").alias("_hs"), "ref_doc", "ref_start")
    moved = again.join(
        head_hits,
        (F.col("doc_id") == F.col("_hd")) & (F.col("_k") == F.col("_hk")) & (F.col("_hs") >= F.col("_s")) & (F.col("_hs") < F.col("_s") + F.col("n")),
    ).select("doc_id", "text_key", (F.col("_hs") + F.col("shift")).alias("start"), F.lit(1).alias("n"), "ref_doc", "ref_start")
    return whole.unionByName(hits).unionByName(moved)


def parse(row: np.ndarray, start: np.ndarray, n: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Greedy factors (row, start, words, ref_doc, ref_start) from the matches of several documents, by row and start.

    A factor is followed while the next match continues it in the same document. Windows that cross its end
    are the next matches in order, so they open factors of their own, which may overlap it.
    """
    order = np.lexsort((ref_start, ref_doc, n, start, row))
    row, start, n, ref_doc, ref_start = (v[order] for v in (row, start, n, ref_doc, ref_start))
    shift, end = ref_start - start, start + n
    same = (row[1:] == row[:-1]) & (ref_doc[1:] == ref_doc[:-1]) & (shift[1:] == shift[:-1])
    alike = np.concatenate([[0], np.cumsum(~same)])
    # How far the matches so far reach, within a run of the same shift; runs are kept apart by a stride.
    stride = int(end.max()) + 1
    reach = np.maximum.accumulate(alike * stride + end) - alike * stride
    opens = np.ones(len(row), bool)
    opens[1:] = ~same | (start[1:] > reach[:-1])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], reach[last] - start[first] + window - 1, ref_doc[first], ref_start[first]


#: Matches and bytes of text that are worked on at a time; a single document may have more.
_MATCHES, _TEXT_BYTES = 1 << 18, 4 << 20


def factors(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, text_key, factors): the duplicate spans of every document that has any, with their references."""
    kind = "array<struct<start: int, words: int, ref_doc: long, ref_start: int>>"

    def work(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            offsets = batch.column(2).offsets.to_numpy()
            for first, last in chunk_bounds(offsets, _MATCHES):
                part = batch.slice(first, last - first)
                found = part.column(2).flatten()
                row = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]))
                values = [found.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("start", "n", "ref_doc", "ref_start")]
                row, *columns = parse(row, *values, window)
                kinds = [("start", pa.int32()), ("words", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]
                spans = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[name for name, _ in kinds])
                bounds = np.searchsorted(row, np.arange(last - first + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(bounds), spans)], names=["doc_id", "text_key", "factors"]
                )

    listed = matches(docs, window).groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("start", "n", "ref_doc", "ref_start")).alias("found")
    )
    return listed.mapInArrow(work, f"doc_id long, text_key long, factors {kind}")


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, text_key, n_words, n_removed, kept_text, factors): every document without its duplicate spans."""
    spans = materialise(factors(docs, window), "factors")

    def parts(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            for first, last in chunk_bounds(buffers(batch.column(1))[1], _TEXT_BYTES):
                yield batch.slice(first, last - first)

    def work(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches_in):
            total, removed, kept = [], [], []
            for text, found in zip(batch.column(1), batch.column(3)):
                raw = text.as_buffer()
                words = raw.to_pybytes().split() if raw is not None else []
                total.append(len(words))
                if found.is_valid:
                    stay = np.ones(len(words), bool)
                    for f in found.as_py():
                        stay[f["start"] : f["start"] + f["words"]] = False
                    words = [words[k] for k in np.flatnonzero(stay)]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(total, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    batch.column(3),
                ],
                names=["doc_id", "text_key", "n_words", "n_removed", "kept_text", "factors"],
            )

    some, others = split_by_ids(texts(docs), spans)
    some, others = some.withColumn("text_key", text_key()), others.withColumn("text_key", text_key())
    spans = spans.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "factors")
    joined = some.join(spans, (some["doc_id"] == spans["_d"]) & (some["text_key"] == spans["_k"]), "left").select(
        "doc_id", "text", "text_key", "factors"
    )
    joined = joined.unionByName(others.withColumn("factors", F.lit(None).cast(spans.schema["factors"].dataType)))
    kind = "array<struct<start: int, words: int, ref_doc: long, ref_start: int>>"
    return joined.mapInArrow(
        work, f"doc_id long, text_key long, n_words long, n_removed long, kept_text string, factors {kind}"
    )
