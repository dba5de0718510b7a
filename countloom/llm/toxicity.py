"""Toxicity of whole texts: a convolutional classifier over hashed word embeddings, trained in numpy.

A text is the sequence of its words, lower-cased and without ASCII punctuation. The embedding of a word is the sum of rows
of one hashed table: one for the whole word, one for each of its first 4, 5 and 6 bytes, so that unseen
endings of a known stem still mean something. Filters of several widths run over the sequence, each keeps its
maximum over the text, and a logistic layer gives the score. One embedding dimension starts at the
log-odds of its table row over the labelled texts; all weights are then trained with Adam on
the cross entropy, in which every class has the same weight.

The classifier is fitted on every labelled row outside the held-out fold, with all its words. The rows are dealt by a hash of the id into shards
of about ``shard`` rows. An epoch is one pass: each shard trains a copy of the net on its rows, then the copies are averaged, a table row over the
copies that met it. So a table of one shard is trained as by a single loop. Only the net (bounded by ``buckets``) passes the driver; a task holds
the words of one shard, and trains a shard of very many words in pieces. Scoring runs over all words of all rows in Arrow batches. Lang, source, id
and labels are never inputs of a score.

Thresholds by language: one in ``calibration`` of the labelled rows (by a hash of the id) never trains the net. Among n clean rows of them the threshold
lies above all but the ``false_rate * (n + 1)`` highest scores, so a further clean text of the language is flagged with at most that probability. A language
with too few of them for the rate uses the threshold of all; where all are too few, nothing is flagged. They decide the extra column ``flagged`` only.

Defined results: null and empty texts score like a text without words. Without training
labels of both classes nothing can be learned and every score is 0. Repeated rows are scored alike. A null label is no label; if an id has several labels, the largest counts.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.functions.ranking import with_running
from countloom.llm.sieve import split_by_ids
from countloom.llm.tables import held
from countloom.llm.text import BASE, buffers, chunk_bounds, hash_runs, locate, mix, powers
from countloom.storage import materialise

_PREFIXES = (4, 5, 6)
_KEEP = np.ones(256, bool)
_KEEP[[b for b in range(33, 127) if not chr(b).isalnum()]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class NetConfig:
    shard: int = 12000
    buckets: int = 1 << 19
    dims: int = 8
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    epochs: int = 4
    batch: int = 64
    rate: float = 0.02
    false_rate: float = 0.01
    calibration: int = 6


@dataclass
class Net:
    table: np.ndarray
    filters: list[np.ndarray]
    shift: list[np.ndarray]
    out: np.ndarray
    bias: float


def word_rows(column: pa.Array, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, table rows of every word (4 per word), word offsets) by chunk."""
    data, offsets = buffers(column)
    for first, last in chunk_bounds(offsets):
        part = _LOWER[data[offsets[first] : offsets[last]]]
        keep = _KEEP[part]
        kept_before = np.concatenate([[0], np.cumsum(keep)])
        bounds = kept_before[offsets[first : last + 1] - offsets[first]]
        part = part[keep]
        inside, starts, ends, words = locate(part, bounds)
        letters, lengths = part[inside].astype(np.uint64) + np.uint64(1), ends - starts
        rows = np.zeros((len(lengths), 1 + len(_PREFIXES)), np.int64)
        mask = np.uint64(buckets - 1)
        rows[:, 0] = (hash_runs(letters, lengths) & mask).astype(np.int64)
        begins = np.cumsum(lengths) - lengths
        scaled = powers(BASE, max(_PREFIXES))
        sums = np.zeros(len(lengths), np.uint64)
        for k in range(max(_PREFIXES)):
            has = lengths > k
            sums[has] += letters[begins[has] + k] * scaled[k]
            if k + 1 in _PREFIXES:
                rows[:, 1 + _PREFIXES.index(k + 1)] = (mix(sums + np.uint64(1000 + k)) & mask).astype(np.int64)
        yield first, rows, words


def _padded(rows: np.ndarray, offsets: np.ndarray, gap: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with ``gap`` empty places after every text, so that no filter spans two texts; row ``buckets`` is the empty word."""
    n = len(offsets) - 1
    counts = np.diff(offsets)
    starts = offsets[:-1] + np.arange(n) * gap
    out = np.full((len(rows) + n * gap, rows.shape[1]), buckets, np.int64)
    at = np.arange(len(rows)) + np.repeat(np.arange(n) * gap, counts)
    out[at] = rows
    return out, starts


def pooled(net: Net, rows: np.ndarray, offsets: np.ndarray, where: bool = False):
    """(maximum of every filter over every text, the places of the maxima if ``where``, embedded words, padded rows)."""
    gap = max(f.shape[0] for f in net.filters)
    padded, starts = _padded(rows, offsets, gap, len(net.table) - 1)
    embedded = net.table[padded].sum(axis=1)
    tops, places = [], []
    for kernel, shift in zip(net.filters, net.shift):
        width = kernel.shape[0]
        n = len(embedded) - width + 1
        value = np.tile(shift, (n, 1))
        for k in range(width):
            value += embedded[k : k + n] @ kernel[k]
        top = np.maximum.reduceat(value, starts, axis=0)
        if where:
            ends = np.append(starts[1:], n)
            places.append(np.array([value[a:b].argmax(axis=0) + a for a, b in zip(starts, ends)]))
        tops.append(top)
    return np.concatenate(tops, axis=1), places, embedded, padded


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def net_scores(net: Net, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    top, _, _, _ = pooled(net, rows, offsets)
    return logistic(np.maximum(top, 0) @ net.out + net.bias)


@dataclass
class Training:
    """A net in training, with the state of Adam and the squared gradients of the table rows."""

    net: Net
    first: list[np.ndarray]
    second: list[np.ndarray]
    head_1: np.ndarray
    head_2: np.ndarray
    squares: np.ndarray

    def dense(self) -> list[np.ndarray]:
        """All but the table rows and their squares."""
        return [*self.net.filters, *self.net.shift, *self.first, *self.second, self.net.out, self.head_1, self.head_2]

    def packed(self) -> np.ndarray:
        return np.concatenate([*[part.ravel().astype(np.float64) for part in self.dense()], [self.net.bias]])

    def unpack(self, values: np.ndarray) -> None:
        at = 0
        for part in self.dense():
            part[...] = values[at : at + part.size].reshape(part.shape)
            at += part.size
        self.net.bias = float(values[at])


def begin(seen: np.ndarray, totals: np.ndarray, config: NetConfig, seed: int = 5) -> tuple[Training, dict]:
    """The untrained net for the numbers of texts by class (``totals``) and by class and table row (``seen``), and the state of the random numbers."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.01, (config.buckets + 1, config.dims)).astype(np.float32)
    odds = np.log((seen[1] + 0.1) / (totals[1] + 1)) - np.log((seen[0] + 0.1) / (totals[0] + 1))
    met = seen.sum(axis=0)
    # Rows seen in few texts say little.
    table[:, 0] += np.where(met > 0, np.clip(odds, -4, 4) * met / (met + 3) / 4, 0).astype(np.float32)
    table[-1] = 0
    kernels, shifts = [], []
    for width in config.widths:
        kernel = rng.normal(0, 0.2, (width, config.dims, config.filters)).astype(np.float32)
        kernel[0, 0, : config.filters // 2] = 1.0
        kernels.append(kernel)
        shifts.append(np.full(config.filters, -0.5, np.float32))
    out = np.full(config.filters * len(config.widths), 0.3)
    net = Net(table, kernels, shifts, out, -2.0)
    first, second = ([np.zeros_like(p) for p in (*net.filters, *net.shift)] for _ in range(2))
    head_1, head_2 = np.zeros(len(out) + 1), np.zeros(len(out) + 1)
    return Training(net, first, second, head_1, head_2, np.full(config.buckets + 1, 1e-8)), rng.bit_generator.state


def train_epoch(state: Training, texts: list[tuple[np.ndarray, int]], totals: np.ndarray, epoch: int, random: dict, config: NetConfig) -> np.ndarray:
    """Train in place on texts (table rows of the words, label), each once; returns the table rows that were changed."""
    net, first, second, head_1, head_2, squares = (getattr(state, f.name) for f in fields(state))
    params = [*net.filters, *net.shift]
    labels = np.array([y for _, y in texts], dtype=np.float64)
    weight = np.where(labels == 1, 0.5 / totals[1], 0.5 / totals[0]) * totals.sum()
    rng = np.random.default_rng()
    rng.bit_generator.state = random
    for _ in range(epoch + 1):
        order = rng.permutation(len(texts))
    step = epoch * -(-len(texts) // config.batch)
    changed = np.zeros(config.buckets + 1, bool)
    for begin in range(0, len(order), config.batch):
        pick = order[begin : begin + config.batch]
        rows = np.concatenate([texts[i][0] for i in pick])
        offsets = np.concatenate([[0], np.cumsum([len(texts[i][0]) for i in pick])])
        top, places, embedded, padded = pooled(net, rows, offsets, where=True)
        live = np.maximum(top, 0)
        error = (logistic(live @ net.out + net.bias) - labels[pick]) * weight[pick] / len(pick)
        back = np.outer(error, net.out) * (top > 0)
        grads, touched, amounts = [], [], []
        shift_grads = []
        for k, kernel in enumerate(net.filters):
            part = back[:, k * config.filters : (k + 1) * config.filters]
            grad = np.zeros_like(kernel)
            for j in range(kernel.shape[0]):
                at = places[k] + j
                here = embedded[at]
                grad[j] = np.einsum("if,ifd->df", part, here)
                touched.append(at.ravel())
                amounts.append((part[:, :, None] * kernel[j].T[None]).reshape(-1, config.dims))
            grads.append(grad)
            shift_grads.append(part.sum(axis=0))
        step += 1
        rate = config.rate / (1 + epoch)
        correct = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for p, g, m, v in zip(params, [*grads, *shift_grads], first, second):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= (rate * correct * m / (np.sqrt(v) + 1e-8)).astype(p.dtype)
        g = np.append(live.T @ error, error.sum())
        head_1[:] = 0.9 * head_1 + 0.1 * g
        head_2[:] = 0.999 * head_2 + 0.001 * g * g
        move = rate * 2 * correct * head_1 / (np.sqrt(head_2) + 1e-8)
        net.out -= move[:-1]
        net.bias -= float(move[-1])
        # Table rows are touched rarely: each has its own step size.
        where = padded[np.concatenate(touched)]
        amount = np.repeat(np.concatenate(amounts), where.shape[1], axis=0)
        flat, inverse = np.unique(where.ravel(), return_inverse=True)
        total = np.zeros((len(flat), config.dims))
        np.add.at(total, inverse, amount)
        total[flat == config.buckets] = 0
        changed[flat] = True
        squares[flat] += (total**2).mean(axis=1)
        net.table[flat] -= (rate * total / np.sqrt(squares[flat])[:, None]).astype(np.float32)
    changed[config.buckets] = False
    return np.flatnonzero(changed)


def labelled(docs: DataFrame, labels: DataFrame, label: str, shards: int) -> DataFrame:
    """(doc_id, text, lang, y, shard): every document with a label outside the held-out fold, shard by shard in the order of the ids.

    An id with several rows gives its least (text, lang). Texts move once: those that may have a label meet the labels in the partition of their shard.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter("y IN (0, 1) AND doc_id IS NOT NULL")
        .filter(~held(0))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    known = materialise(known, "labels")
    near, _ = split_by_ids(rows.filter("doc_id IS NOT NULL").filter(~held(0)), known)
    both = near.select("doc_id", F.struct("text", "lang").alias("row"), F.lit(None).cast("int").alias("y")).unionByName(
        known.select("doc_id", F.lit(None).cast("struct<text: string, lang: string>").alias("row"), "y")
    )
    # The partitions of the shards serve the grouping as well, so nothing moves again.
    spread = both.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).repartition(shards, "shard")
    met = spread.groupBy("shard", "doc_id").agg(F.min("row").alias("row"), F.max("y").alias("y")).filter("row IS NOT NULL AND y IS NOT NULL")
    return met.select("doc_id", "row.text", "row.lang", "y", "shard").sortWithinPartitions("shard", "doc_id")


#: Table rows whose sums are added up in one task, and words that a task holds before it trains on them.
_RANGE, _HELD_WORDS = 1 << 15, 1 << 24


def _by_range(ids: np.ndarray, *tables: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Values that ``tables`` hold for table rows, side by side, cut by ranges of rows; a 1 is added to each, which counts the parts that hold it."""
    for at in np.unique(ids // _RANGE).tolist():
        a, b = np.searchsorted(ids, [at * _RANGE, (at + 1) * _RANGE])
        values = np.concatenate([*[t[ids[a:b]].astype(np.float64) for t in tables], np.ones((b - a, 1))], axis=1)
        lists = [pa.array([ids[a:b].astype(np.int32)], pa.list_(pa.int32())), pa.array([values.ravel()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *lists], names=["range", "ids", "values"])


def _added(parts: DataFrame, width: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums of (range, ids, values) by id: range to (ids, sums). At most one array per range reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def row():
            ids = np.flatnonzero(sums[:, -1])
            lists = [pa.array([(ids + now * _RANGE).astype(np.int32)], pa.list_(pa.int32())), pa.array([sums[ids].ravel()], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *lists], names=["range", "ids", "values"])

        for batch in batches:
            for k in range(batch.num_rows):
                at = batch.column(0)[k].as_py()
                if at != now:
                    if now is not None:
                        yield row()
                    now, sums = at, np.zeros((_RANGE, width))
                ids = batch.column(1)[k].values.to_numpy() - at * _RANGE
                sums[ids] += batch.column(2)[k].values.to_numpy().reshape(-1, width)
        if now is not None:
            yield row()

    found = parts.repartition("range").sortWithinPartitions("range").mapInArrow(run, "range int, ids array<int>, values array<double>")
    return {r.range: (np.array(r.ids, np.int64), np.array(r["values"]).reshape(-1, width)) for r in found.toLocalIterator()}


def fit(docs: DataFrame, labels: DataFrame, label: str, config: NetConfig) -> tuple[Net | None, dict[str | None, float]]:
    """The net and the thresholds by language (key None: any other language)."""
    spark = docs.sparkSession
    # As many shards as there may be rows, from the ids alone, so that the texts are written once.
    ids = labels.filter(F.col(label).cast("int").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id")).filter(~held(0)).distinct()
    shards = max(1, -(-ids.count() // config.shard))
    aside = F.crc32(F.concat(F.lit("calibration:"), F.col("doc_id").cast("string"))) % config.calibration == 0
    rows = materialise(labelled(docs, labels, label, shards).withColumn("aside", aside), "labelled")
    training = rows.filter("NOT aside").select("text", "y", "shard")
    counted = {r.y: r["count"] for r in training.groupBy("y").count().collect()}
    totals = np.array([counted.get(0, 0), counted.get(1, 0)])
    if not totals.all():
        return None, {None: 0.5}

    def meets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((config.buckets + 1, 2))
        for batch in batches:
            ys = batch.column(1).to_pylist()
            for first, words, offsets in word_rows(batch.column(0), config.buckets):
                for k in range(len(offsets) - 1):
                    seen[np.unique(words[offsets[k] : offsets[k + 1]]), ys[first + k]] += 1
        met = np.flatnonzero(seen.sum(axis=1))
        yield from _by_range(met, seen)

    seen = np.zeros((2, config.buckets + 1))
    for ids, sums in _added(training.mapInArrow(meets, "range int, ids array<int>, values array<double>"), 3).values():
        seen[:, ids] = sums[:, :2].T
    state, random = begin(seen, totals, config)
    for epoch in range(config.epochs):
        sent = spark.sparkContext.broadcast({**{f.name: getattr(state, f.name) for f in fields(state) if f.name != "net"}, "net": {f.name: getattr(state.net, f.name) for f in fields(state.net)}})

        def learn(batches: Iterator[pa.RecordBatch], epoch=epoch, sent=sent) -> Iterator[pa.RecordBatch]:
            def trained(texts):
                own = copy.deepcopy(sent.value)
                own = Training(Net(**own.pop("net")), **own)
                changed = train_epoch(own, texts, totals, epoch, random, config)
                yield from _by_range(changed, own.net.table, own.squares[:, None])
                dense = own.packed()
                lists = [pa.array([np.arange(len(dense), dtype=np.int32) - _RANGE], pa.list_(pa.int32())), pa.array([np.stack([dense, *[np.zeros(len(dense))] * config.dims, np.ones(len(dense))], axis=1).ravel()], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *lists], names=["range", "ids", "values"])

            now, texts, words_held = None, [], 0
            for batch in batches:
                ys, of = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                for first, words, offsets in word_rows(batch.column(0), config.buckets):
                    for k in range(len(offsets) - 1):
                        if texts and (of[first + k] != now or words_held > _HELD_WORDS):
                            yield from trained(texts)
                            texts, words_held = [], 0
                        now = of[first + k]
                        texts.append((words[offsets[k] : offsets[k + 1]].astype(np.int32), ys[first + k]))
                        words_held += len(texts[-1][0])
            if texts:
                yield from trained(texts)

        found = _added(training.mapInArrow(learn, "range int, ids array<int>, values array<double>"), config.dims + 2)
        for at, (ids, sums) in found.items():
            mean = sums[:, :-1] / sums[:, -1:]
            if at < 0:
                state.unpack(mean[:, 0])
            else:
                state.net.table[ids], state.squares[ids] = mean[:, :-1], mean[:, -1]
        sent.destroy()
    return state.net, _limits(rows.filter("aside"), state.net, config)


def _limits(rows: DataFrame, net: Net, config: NetConfig) -> dict[str | None, float]:
    """``thresholds`` of the clean rows among (text, lang, y), by ranks that Spark works out; one number per language reaches the driver."""
    scored = materialise(_scored(rows.filter("y = 0").select("doc_id", "text", "lang"), net, config), "calibration")
    above = F.floor(config.false_rate * (F.col("group_rows") + 1) + 1e-9)
    cut = lambda df, group: with_running(df, group, [F.desc("score")]).filter(F.col("rank") == above).select(*group, "score").collect()
    of_all = [float(np.nextafter(r.score, 2)) for r in cut(scored.withColumn("every", F.lit(1)), ["every"])]
    own = {r.lang: float(np.nextafter(r.score, 2)) for r in cut(scored.filter("lang IS NOT NULL"), ["lang"])}
    return {None: of_all[0] if of_all else 2.0, **own}


def thresholds(scores: np.ndarray, ys: np.ndarray, langs: list[str | None], false_rate: float) -> dict[str | None, float]:
    """Per language the threshold that a further clean text reaches with probability ``false_rate`` at most (split conformal)."""

    def cut(clean: np.ndarray) -> float | None:
        above = int(false_rate * (len(clean) + 1) + 1e-9)
        return float(np.nextafter(np.sort(clean)[-above], 2, dtype=np.float64)) if above else None

    names = np.array([x if x is not None else "" for x in langs], dtype=object)
    of_all = cut(scores[ys == 0])
    out: dict[str | None, float] = {None: 2.0 if of_all is None else of_all}
    for name in set(x for x in langs if x is not None):
        own = cut(scores[(names == name) & (ys == 0)])
        if own is not None:
            out[name] = own
    return out


def _scored(rows: DataFrame, net: Net | None, config: NetConfig) -> DataFrame:
    """(doc_id, lang, score) of (doc_id, text, lang)."""
    model = rows.sparkSession.sparkContext.broadcast(None if net is None else {f.name: getattr(net, f.name) for f in fields(net)})
    net_missing = net is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = None if net_missing else Net(**model.value)
        for batch in batches:
            if net_missing:
                zeros = pa.array(np.zeros(batch.num_rows))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), zeros], names=["doc_id", "lang", "score"])
                continue
            for first, rows, offsets in word_rows(batch.column(1), config.buckets):
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(net_scores(net, rows, offsets).astype(np.float64))],
                    names=["doc_id", "lang", "score"],
                )

    return rows.mapInArrow(run, "doc_id long, lang string, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", config: NetConfig = NetConfig()) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, flagged) of every document."""
    net, limits = fit(docs, labels, label, config)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    scored = _scored(rows, net, config)
    # Only languages with enough clean rows have a threshold of their own.
    limit = F.lit(limits[None])
    for name, value in sorted((k, v) for k, v in limits.items() if k is not None):
        limit = F.when(F.col("lang") == name, F.lit(value)).otherwise(limit)
    return scored.select(
        "doc_id",
        held(0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        limit.alias("threshold"),
        (F.col("score") >= limit).alias("flagged"),
    )
