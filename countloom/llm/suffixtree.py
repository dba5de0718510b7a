"""Language-model scores from a probabilistic suffix tree over words.

Tokens are lower-cased words and one end token per text. The tree is learned from the training rows:

* A word sequence takes part if it occurs at least ``floor`` times, whatever the size of the corpus, so more text gives more contexts.
* A context is such a sequence of at most ``length`` words; its followers are the words and ends that occur ``floor`` times after it. It stays
  in the tree if its distribution differs from its parent's (the context without its first word): count * KL divergence must exceed
  ``divergence``. An ancestor of a kept context is kept.
* Smoothing: a kept follower x of context c has (count(c, x) - discount) / count(c); the mass that is left goes to all other
  words in proportion to the parent's distribution. The root has (c + 0.5) / (N + 0.5 * (V + 1)) for a word seen c times.
* A token is predicted from the longest context in the tree that ends just before it.

Followers of a context also follow its parent, and ancestors are kept. So the score of a token is its root score plus one term for each word
sequence of up to ``length`` + 1 tokens that ends with it or just before it: a term for having the context, and one for the follower. The
terms of all sequences are a table that grows with the corpus. Those of sequences with at least the probability ``least`` (at most
(length + 1) / least) are broadcast, and the others meet the sequences of the texts in one shuffle; where the line lies changes no result. In the same way
the most frequent ``head`` words are broadcast and the other words of every text are looked up in that shuffle. The keys lie in groups, ranges whose number
grows with the terms; a task sends those of many texts at once, sorted, by group, so that they travel as small differences. A bit table of fixed size keeps sequences that
certainly have no entry out of the shuffles; it lets more rows through as the corpus grows and turns none away wrongly.

Defined results: a null or empty text has one token, the end. A null id is not held out. Only ``doc_id`` and ``text`` are read.
Without training rows N and V are 0 and every token has probability 1 at the root, as the formula says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.tables import held, text_key, texts
from countloom.llm.text import BASE, Words, mix, word_chunks
from countloom.storage import materialise

#: The token at the end of every text, and the mark before its first word.
END = np.uint64(0x5EED0E2D)


@dataclass(frozen=True)
class TreeConfig:
    """``floor``: count of a word sequence from which it takes part; ``least``: its probability from which its term is broadcast."""

    length: int = 3
    least: float = 1e-5
    floor: int = 4
    divergence: float = 8.0
    discount: float = 0.5
    head: int = 1 << 18


def tokens(chunk: Words) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets): the words of every text followed by the end token."""
    n = chunk.last - chunk.first
    offsets = chunk.offsets + np.arange(n + 1)
    out = np.empty(len(chunk.hash) + n, np.uint64)
    ends = offsets[1:] - 1
    rest = np.ones(len(out), bool)
    rest[ends] = False
    out[rest] = chunk.hash
    out[ends] = END
    return out, offsets


def joined_key(context: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Key of the sequence whose tokens but the last are ``context`` and whose tokens but the first are ``below``."""
    return mix((context ^ np.uint64(0xA5A5A5A5)) * BASE + below)


def sequences(words: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, whether it lies in its text) of the sequence of ``length`` tokens that ends at every token."""
    key = words.copy()
    for _ in range(1, length):
        key[1:] = joined_key(key[:-1], key[1:])
    inside = np.arange(len(words)) - np.repeat(offsets[:-1], np.diff(offsets))
    return key, inside >= length - 1


#: Bits of a sieve.
_SIEVE = 1 << 26


def sieve(keys: DataFrame) -> np.ndarray:
    """Bits set for the column ``key``; a key whose bit is not set is certainly not among them."""
    place = keys.select((F.col("key").bitwiseAND(F.lit(_SIEVE - 1))).alias("p"))
    words = place.selectExpr("cast(shiftright(p, 6) as int) AS word", "shiftleft(1L, cast(p & 63 as int)) AS bit")
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(_SIEVE // 64, np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table.view(np.uint64)


def may_have(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(_SIEVE - 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


class Lookup:
    """Positions of 64-bit keys in a sorted table."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The position of each value in the original keys, or -1."""
        if not len(self.keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], -1)


def _counted(column: pa.Array, each) -> Iterator[pa.RecordBatch]:
    for chunk in word_chunks(column, lower=True):
        keys, *more = each(*tokens(chunk))
        found, first, counts = np.unique(keys, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.view(np.int64)), *[pa.array(m[first].view(np.int64)) for m in more], pa.array(counts)],
            names=["key", *[f"part_{k}" for k in range(len(more))], "n"],
        )


def word_counts(rows: DataFrame) -> DataFrame:
    """(key, n) of every token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _counted(batch.column(0), lambda words, offsets: (words,))

    return rows.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _packed(values: np.ndarray) -> bytes:
    """First bytes next to first bytes, and so on, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, dtype: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    planes = pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(dtype).ravel()


#: Sequences that a task adds up before it sends them on, and tokens of the corpus for each group that they are sent to.
_HELD, _GROUP = 1 << 19, 1 << 19


def _pairs(context: np.ndarray, below: np.ndarray, n: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, context, below, n) with the counts of equal pairs added up, group by group.

    Inside a group equal contexts lie next to each other, so that they compress well.
    """
    key = joined_key(context, below)
    group = (key >> np.uint64(16)) % np.uint64(groups)
    order = np.argsort((group << np.uint64(48)) | (context >> np.uint64(40) << np.uint64(24)) | (key >> np.uint64(40)))
    key = key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(fresh)
    sums, first = np.add.reduceat(n[order], begin), order[begin]
    group = group[first]
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield int(group[a]), context[first[a:b]], below[first[a:b]], sums[a:b]


def sequence_counts(rows: DataFrame, length: int, shorter: DataFrame, floor: int, total: int) -> DataFrame:
    """(key, context, below, n): the sequences of ``length`` tokens that occur ``floor`` times, without the last token and without the first.

    Both shorter sequences are then in ``shorter`` as well. ``total`` is the number of tokens. A task adds up its sequences, and they travel as
    packed arrays by group, one row per task and group: the groups, cut by the key's hash, grow in number with the corpus and not in size.
    """
    model = rows.sparkSession.sparkContext.broadcast(sieve(shorter))
    groups = min(1 + total // _GROUP, 1 << 16)
    names = ["group", "context", "below", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, size = model.value, [], 0

        def sent():
            context, below = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            for group, *parts in _pairs(context, below, np.ones(len(context), np.int64), groups):
                packed = [pa.array([_packed(x)], pa.binary()) for x in (parts[0], parts[1], parts[2].astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), *packed], names)

        for batch in batches:
            for chunk in word_chunks(batch.column(0), lower=True):
                words, offsets = tokens(chunk)
                below, _ = sequences(words, offsets, length - 1)
                may = may_have(bits, below)
                able = may & (np.arange(len(words)) - np.repeat(offsets[:-1], np.diff(offsets)) >= length - 1)
                able[1:] &= may[:-1]
                at = np.flatnonzero(able)
                held.append((below[at - 1], below[at]))
                size += len(at)
                if size >= _HELD:
                    yield from sent()
                    held, size = [], 0
        if size:
            yield from sent()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def often():
            context, below, n = (np.concatenate([h[i] for h in held]) for i in range(3))
            for _, *parts in _pairs(context, below, n, 1):
                enough = parts[2] >= floor
                context, below, n = (x[enough] for x in parts)
                columns = [joined_key(context, below), context, below]
                yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in columns], pa.array(n)], names=["key", "context", "below", "n"])

        for batch in batches:
            for i, group in enumerate(batch.column(0).to_pylist()):
                if group != now and held:
                    yield from often()
                    held = []
                now = group
                context, below, n = (batch.column(k)[i].as_py() for k in (1, 2, 3))
                held.append((_unpacked(context, np.uint64), _unpacked(below, np.uint64), _unpacked(n, np.uint32).astype(np.int64)))
        if held:
            yield from often()

    found = rows.select("text").mapInArrow(run, "group int, context binary, below binary, n binary")
    spread = found.select(*names).repartition("group").sortWithinPartitions("group")
    return spread.mapInArrow(added, "key long, context long, below long, n long")


@dataclass
class Tree:
    """``terms`` (key, n, depth, value): log10 term of every sequence; ``depth`` is its length if it is a kept context, or else 0.

    ``keys`` and ``values`` are the terms of the frequent sequences, ``contexts`` and ``depth`` the kept contexts among these; ``tail``
    has the other terms, or is None if there are none.
    """

    terms: DataFrame
    tail: DataFrame | None
    keys: np.ndarray
    values: np.ndarray
    contexts: np.ndarray
    depth: np.ndarray


def _arrays(table: DataFrame) -> dict[str, np.ndarray]:
    """A table of bounded size as columns."""
    found = table.toArrow()
    return {c: found[c].to_numpy() for c in found.column_names}


def learn(rows: DataFrame, config: TreeConfig, counts: DataFrame, total: int, distinct: int) -> Tree:
    """The tree of the training texts ``rows``, whose token counts are ``counts``."""
    scale = float(total + 0.5 * (distinct + 1))
    root = ((F.col("n") + F.lit(0.5)) / F.lit(scale)).alias("p")
    level = counts.filter(F.col("n") >= config.floor).select("key", F.lit(None).cast("long").alias("below"), "n", root)
    followers, nodes = [], []
    for length in range(1, config.length + 1):
        # ``level`` has the sequences of ``length`` tokens: the contexts, and the followers of their parents.
        found = materialise(sequence_counts(rows, length + 1, level, config.floor, total), "sequences")
        seen = level.select(F.col("key").alias("context"), F.col("below").alias("parent"), F.col("n").alias("seen"))
        under = level.select(F.col("key").alias("below"), F.col("p").alias("q"))
        joined = found.join(seen, "context").join(under, "below")
        longer = materialise(joined.withColumn("p", (F.col("n") - F.lit(config.discount)) / F.col("seen")), "followers")
        sums = longer.groupBy("context").agg(
            F.first("parent").alias("parent"),
            F.first("seen").alias("seen"),
            (1 - F.sum("p")).alias("rest"),
            (1 - F.sum("q")).alias("rest_below"),
            F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("gain"),
        )
        bad = (F.col("rest") <= 0) | (F.col("rest_below") <= 0)
        sums = sums.withColumns(
            {
                "rest": F.when(bad, F.greatest("rest", F.lit(config.discount) / F.col("seen"))).otherwise(F.col("rest")),
                "rest_below": F.when(bad, F.greatest("rest_below", F.lit(1e-12))).otherwise(F.col("rest_below")),
            }
        )
        share = F.col("rest") / F.col("rest_below")
        strong = F.col("seen") * (F.col("gain") + F.col("rest") * F.log(share)) > config.divergence
        nodes.append(materialise(sums.select("context", "parent", "seen", F.log10(share).alias("weight"), strong.alias("strong")), "contexts"))
        followers.append(longer)
        level = longer
    terms = needed = None
    for length in range(config.length, 0, -1):
        kept = nodes[length - 1]
        if needed is not None:
            kept = kept.join(needed.withColumn("needed", F.lit(True)), "context", "left").filter("strong OR needed").drop("needed")
        else:
            kept = kept.filter("strong")
        kept = materialise(kept, "kept")
        needed = kept.select(F.col("parent").alias("context")).distinct()
        own = kept.select(F.col("context").alias("key"), F.col("seen").alias("n"), F.lit(length).alias("depth"), F.col("weight").alias("value"))
        more = followers[length - 1].join(kept.select("context", "weight"), "context")
        more = more.select("key", "n", F.lit(0).alias("depth"), (F.log10(F.col("p") / F.col("q")) - F.col("weight")).alias("value"))
        both = own.unionByName(more)
        terms = both if terms is None else terms.unionByName(both)
    summed = terms.groupBy("key").agg(F.max("n").alias("n"), F.max("depth").alias("depth"), F.sum("value").alias("value"))
    terms = materialise(summed, "terms")
    frequent = F.col("n") >= config.least * total
    head = _arrays(terms.filter(frequent))
    tail = terms.filter(~frequent)
    keys, contexts = head["key"].astype(np.int64).view(np.uint64), head["depth"] > 0
    return Tree(
        terms, None if tail.isEmpty() else tail, keys, head["value"].astype(np.float64), keys[contexts], head["depth"][contexts].astype(np.int64)
    )


#: Kinds of the rows that travel by group, in the order in which a group needs them: terms, counts of words, the sequences and the words that texts
#: ask for, and the texts.
_TERM, _COUNT, _SEQUENCE, _WORD, _TEXT = range(5)
#: Terms of a group.
_TERMS = 1 << 20
_SENT = (
    "group int, kind int, base long, keys binary, rows binary, numbers binary, row long, doc_id long, text_key long, n_tokens long, n_known long, "
    "base_score double, score double"
)
_SENT_SCHEMA = pa.schema(
    [("group", pa.int32()), ("kind", pa.int32()), ("base", pa.int64()), ("keys", pa.binary()), ("rows", pa.binary()), ("numbers", pa.binary())]
    + [(c, pa.int64()) for c in ("row", "doc_id", "text_key", "n_tokens", "n_known")]
    + [(c, pa.float64()) for c in ("base_score", "score")]
)


def _batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
    """Rows to send; the columns that are not given are null."""
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _SENT_SCHEMA], schema=_SENT_SCHEMA)


def _by_group(kind: int, keys: np.ndarray, numbers: np.ndarray, groups: int, rows: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Sorted ``keys`` and what goes with them, one row per group; the groups cut the range of the keys, which travel as differences."""
    group = (keys >> np.uint64(40)) * np.uint64(groups) >> np.uint64(24)
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
    base = 0 if rows is None else int(rows.min())
    for a, b in zip(bounds[:-1], bounds[1:]):
        columns = {
            "group": pa.array([int(group[a])], pa.int32()),
            "kind": pa.array([kind], pa.int32()),
            "base": pa.array([base], pa.int64()),
            "keys": pa.array([_packed(np.diff(keys[a:b], prepend=np.uint64(0)))], pa.binary()),
            "numbers": pa.array([_packed(numbers[a:b])], pa.binary()),
        }
        if rows is not None:
            columns["rows"] = pa.array([_packed((rows[a:b] - base).astype(np.uint32))], pa.binary())
        yield _batch(1, **columns)


def _asked(kind: int, keys: np.ndarray, rows: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    """The keys that rows ask for, each once per row with its number of uses."""
    order = np.lexsort((rows, keys))
    keys, rows = keys[order], rows[order]
    begin = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])))
    uses = np.diff(np.append(begin, len(keys))).astype(np.uint32)
    yield from _by_group(kind, keys[begin], uses, groups, rows[begin])


def _answers(table: DataFrame, kind: int, groups: int) -> DataFrame:
    """The pairs of ``table`` (key, value) by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent():
            keys, values = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            order = np.argsort(keys)
            yield from _by_group(kind, keys[order], values[order], groups)

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
                size += batch.num_rows
            if size >= _HELD:
                yield from sent()
                held, size = [], 0
        if size:
            yield from sent()

    return table.select("key", F.col("value").cast("double").alias("value")).mapInArrow(run, _SENT)


def _answered(sent: DataFrame, scale: float) -> DataFrame:
    """(row, doc_id, text_key, n_tokens, n_known, base_score, score): the texts as they are, and what their rows get from every group."""
    names = ["row", "doc_id", "text_key", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tables, found = None, {}, {}
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            texts_here = batch.filter(pa.array(kinds == _TEXT))
            if texts_here.num_rows:
                yield texts_here.select(names)
            for i in np.flatnonzero(kinds != _TEXT).tolist():
                group, kind = batch.column(0)[i].as_py(), int(kinds[i])
                if group != now:
                    now, tables, found = group, {_TERM: [], _COUNT: []}, {}
                keys = np.cumsum(_unpacked(batch.column(3)[i].as_py(), np.uint64), dtype=np.uint64)
                if kind in tables:
                    tables[kind].append((keys, _unpacked(batch.column(5)[i].as_py(), np.float64)))
                    continue
                answer = _TERM if kind == _SEQUENCE else _COUNT
                if answer not in found:
                    parts = tables[answer]
                    known = Lookup(np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64))
                    found[answer] = known, np.append(np.concatenate([v for _, v in parts]) if parts else np.zeros(0), 0.0)
                    tables[answer] = []
                known, values = found[answer]
                value = values[known.find(keys)]
                uses = _unpacked(batch.column(5)[i].as_py(), np.uint32).astype(np.int64)
                rows, of = np.unique(_unpacked(batch.column(4)[i].as_py(), np.uint32), return_inverse=True)
                total = lambda weights: np.bincount(of, weights, len(rows))
                if kind == _SEQUENCE:
                    own, base, seen = total(uses * value), np.zeros(len(rows)), np.zeros(len(rows))
                else:
                    own = base = total(uses * np.log10((value + 0.5) / scale))
                    seen = total(uses * (value > 0))
                nothing = pa.nulls(len(rows), pa.int64())
                at = pa.array(rows.astype(np.int64) + batch.column(2)[i].as_py())
                yield pa.RecordBatch.from_arrays([at, nothing, nothing, nothing, pa.array(seen.astype(np.int64)), pa.array(base), pa.array(own)], names=names)

    spread = sent.repartition("group").sortWithinPartitions("group", "kind")
    return spread.mapInArrow(run, "row long, doc_id long, text_key long, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, training: DataFrame, config: TreeConfig = TreeConfig()) -> DataFrame:
    """(doc_id, text_key, n_tokens, n_known, train_tokens, base_score, score) of ``docs``, learned from ``training``."""
    counts = materialise(word_counts(texts(training)), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tree = learn(texts(training), config, counts, total, distinct)
    # A bounded number of words, by count; ties by key.
    head = _arrays(counts.orderBy(F.desc("n"), "key").limit(config.head))
    scale = total + 0.5 * (distinct + 1)
    context = docs.sparkSession.sparkContext
    rest = None if tree.tail is None else sieve(tree.tail)
    # With all words in the head, the others are certainly not in the training texts.
    all_words = distinct <= config.head
    groups = min(1 + ((0 if tree.tail is None else tree.tail.count()) + (0 if all_words else distinct)) // _TERMS, 1 << 16)
    model = context.broadcast((tree.keys, tree.values, sieve(tree.terms), rest, head["key"].astype(np.int64), head["n"].astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_keys, values, any_bits, tail_bits, keys, n = model.value
        common, known = Lookup(keys.view(np.uint64)), Lookup(found_keys)
        n = np.append(n, 0)
        root_log = np.log10((n + 0.5) / scale)
        # The words and the sequences outside the broadcast heads, with the rows that have them.
        held, size = {_SEQUENCE: [], _WORD: []}, 0

        def ask(kind: int, keys: np.ndarray, rows: np.ndarray) -> int:
            if len(keys):
                held[kind].append((keys, rows))
            return len(keys)

        def sent():
            for kind, parts in held.items():
                if parts:
                    keys, rows = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                    parts.clear()
                    yield from _asked(kind, keys, rows, groups)

        for batch in batches:
            for chunk in word_chunks(batch.column(1), lower=True):
                words, offsets = tokens(chunk)
                here = chunk.last - chunk.first
                row = batch.column(3).slice(chunk.first, here)
                of = np.repeat(row.to_numpy(), np.diff(offsets))
                at = common.find(words)
                tail = at < 0
                base = root_log[at]
                if not all_words:
                    base[tail] = 0.0
                    size += ask(_WORD, words[tail], of[tail])
                own = base.copy()
                for length in range(1, config.length + 2):
                    key, able = sequences(words, offsets, length)
                    place = np.flatnonzero(able & may_have(any_bits, key))
                    hit = known.find(key[place])
                    got = hit >= 0
                    own[place[got]] += values[hit[got]]
                    if tail_bits is not None:
                        place = place[~got]
                        place = place[may_have(tail_bits, key[place])]
                        size += ask(_SEQUENCE, key[place], of[place])
                yield _batch(
                    here,
                    group=pa.array((-1 - (row.to_numpy() & 1023)).astype(np.int32)),
                    kind=pa.array(np.full(here, _TEXT, np.int32)),
                    row=row,
                    doc_id=batch.column(0).slice(chunk.first, here),
                    text_key=batch.column(2).slice(chunk.first, here),
                    n_tokens=pa.array(np.diff(offsets)),
                    n_known=pa.array(np.add.reduceat(~tail & (n[at] > 0), offsets[:-1], dtype=np.int64)),
                    base_score=pa.array(np.add.reduceat(base, offsets[:-1])),
                    score=pa.array(np.add.reduceat(own, offsets[:-1])),
                )
                if size >= _HELD:
                    yield from sent()
                    size = 0
        yield from sent()

    # The rows are numbered where they are read, so equal rows stay apart.
    rows = texts(docs).select("doc_id", "text", text_key().alias("text_key"), F.monotonically_increasing_id().alias("row"))
    out = rows.mapInArrow(run, _SENT)
    answers = [] if tree.tail is None else [_answers(tree.tail.select("key", "value"), _TERM, groups)]
    if not all_words:
        answers.append(_answers(counts.select("key", F.col("n").alias("value")), _COUNT, groups))
    if answers:
        for more in answers:
            out = out.unionByName(more)
        out = _answered(out, scale).groupBy("row").agg(
            *[F.max(c).alias(c) for c in ("doc_id", "text_key", "n_tokens")], *[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")]
        )
    return out.select("doc_id", "text_key", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def score_held_out(docs: DataFrame, remainder: int = 1, config: TreeConfig = TreeConfig()) -> DataFrame:
    """All of ``docs`` scored by a tree of the rows whose crc32 of the id leaves another remainder; adds ``held_out``."""
    out = score(docs, docs.filter(~held(remainder)), config)
    return out.withColumn("held_out", held(remainder))
