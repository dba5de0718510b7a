"""Best-fit packing of documents into sequences of several permitted lengths.

Lengths are counted in words. A document longer than the largest permitted length is cut into chunks of that length and a
rest. Chunks are dealt by a hash into groups of bounded expected size, and each group is packed on its own, longest
first:

* A chunk goes to the open bin with the least room that still holds it (best fit).
* If none does, a bin is opened whose size has the least expected cost per packed word among the permitted sizes that hold the chunk. The
  cost of a sequence of n words is n * (1 + n / ``quadratic``) + ``overhead``. Its expected contents are the chunk and what of the chunks
  still to be placed would go into it, longest first; the cost is that of the least length that holds them. So a size wins by what it
  will hold, and equal chunks may open different sizes.
* In the end every bin is downsized to the least permitted length that holds its contents.

The packing of a group depends on its chunks only, so a retried task repeats it, and a group has thousands of chunks, so
little is lost against one packing of all. Only ids and lengths are shuffled.

Defined results: texts without words (or null) are packed nowhere. Rows equal in id and text are separate copies. Null ids are packed like others.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.tables import WORD, text_key, texts, word_slice
from countloom.storage import materialise


@dataclass(frozen=True)
class PackConfig:
    """``group``: expected number of chunks packed together."""

    lengths: tuple[int, ...] = (512, 1024, 2048, 4096)
    overhead: float = 64.0
    quadratic: float = 4096.0
    group: int = 20000

    def cost(self, n: float) -> float:
        return n * (1 + n / self.quadratic) + self.overhead


def chunks(docs: DataFrame, config: PackConfig) -> DataFrame:
    """(doc_id, text_key, copies, chunk, start, length): the chunks of every distinct text of a document."""
    longest = max(config.lengths)
    sized = texts(docs).select("doc_id", text_key().alias("text_key"), F.regexp_count("text", F.lit(WORD)).alias("n_words"))
    distinct = sized.filter("n_words > 0").groupBy("doc_id", "text_key", "n_words").agg(F.count(F.lit(1)).alias("copies"))
    cut = distinct.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_words") - 1) / longest).cast("int"))))
    start = F.col("chunk") * longest
    return cut.select(
        "doc_id", "text_key", "copies", "chunk", start.cast("int").alias("start"), F.least(F.lit(longest), F.col("n_words") - start).cast("int").alias("length")
    )


def pack_group(lengths: np.ndarray, config: PackConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of every item and the final size of every bin; ``lengths`` must not rise."""
    sizes = sorted(config.lengths)
    ahead, remaining = np.unique(lengths, return_counts=True)
    ahead, left_of = ahead.tolist(), dict(zip(ahead.tolist(), remaining.tolist()))

    def expected_cost(length: int, size: int) -> float:
        room, upper = size - length, size
        while room:
            k = bisect.bisect_right(ahead, min(room, upper))
            if not k:
                break
            upper = ahead[k - 1]
            room -= min(left_of[upper], room // upper) * upper
            upper -= 1
        used = size - room
        return config.cost(sizes[bisect.bisect_left(sizes, used)]) / used

    rooms: list[int] = []
    stacks: dict[int, list[int]] = {}
    used: list[int] = []
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        left_of[length] -= 1
        if not left_of[length]:
            ahead.pop()
        at = bisect.bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            stack = stacks[room]
            place = stack.pop()
            if not stack:
                del stacks[room]
                rooms.pop(at)
        else:
            room, place = min((s for s in sizes if s >= length), key=lambda s: (expected_cost(length, s), s)), len(used)
            used.append(0)
        bins[i], offsets[i] = place, used[place]
        used[place] += length
        left = room - length
        if left:
            if left in stacks:
                stacks[left].append(place)
            else:
                stacks[left] = [place]
                bisect.insort(rooms, left)
    final = np.array(sizes)[np.searchsorted(sizes, np.array(used, dtype=np.int64))] if used else np.zeros(0, np.int64)
    return bins, offsets, final


def pack(docs: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """(doc_id, text_key, copy, chunk, start, length, bin_group, bin, capacity, position): where every chunk of every document lies."""
    # Written first: the count and the packing would both cut all texts.
    cut = materialise(chunks(docs, config), "chunks").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    cut = cut.withColumn("copy", F.col("copy") - 1)
    total = cut.count()
    groups = max(1, -(-total // config.group))
    dealt = cut.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "text_key", "copy", "chunk"), F.lit(groups)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values(["length", "doc_id", "text_key", "copy", "chunk"], ascending=[False, True, True, True, True])
        bins, offsets, final = pack_group(ordered["length"].to_numpy(), config)
        return ordered.assign(doc_id=ordered["doc_id"].astype("Int64"), bin=bins, capacity=final[bins], position=offsets)

    return dealt.groupBy("bin_group").applyInPandas(
        run,
        "doc_id long, text_key long, chunk int, start int, length int, copy int, bin_group long, bin long, capacity long, position long",
    )


def packed_texts(docs: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """``pack`` with the text of every chunk instead of its key."""
    placed = pack(docs, config).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    rows = texts(docs).withColumn("text_key", text_key()).dropDuplicates(["doc_id", "text_key"])
    joined = rows.join(placed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    text = word_slice(F.col("start"), F.col("length"))
    return joined.select(
        "doc_id", "chunk", "start", "length", "copy", "bin_group", "bin", "capacity", "position", text.alias("text")
    )
