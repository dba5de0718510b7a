"""Fill-in-the-middle documents, cut by rank queries on a wavelet matrix.

A unit is a word with the white space before it; white space at the end of a text is a unit of its own. Two pseudorandom
numbers of units cut a text into prefix, middle and suffix, which are then put in another order behind sentinels.

Every byte of the UTF-8 text gets a symbol of three bits: its class (white space, other ASCII, first byte of a longer
character, continuation byte) and whether a unit ends behind it. A wavelet matrix over these symbols answers how often a
symbol occurs before a position. The number of unit ends before a position is the sum of four such ranks, and bisection
on that sum finds the place of a cut. The number of characters is the position less the ranks of the two
continuation symbols. One matrix holds the texts of about a megabyte one after the other, or one longer text, and all
their cuts are searched together.

Results: one row per row of the input. A null text counts as empty; an empty text, and one that contains a sentinel, stays
as it is. A null id is hashed as no digits. Rows that repeat give the same result each, as the cuts depend on id and text only.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.llm.tables import texts
from countloom.llm.text import SEPARATORS, buffers, chunk_bounds

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_CHUNK_BYTES = 1 << 20
_LEVELS = 3
#: Classes of bytes; a symbol is twice the class, plus one if a unit ends behind the byte.
_BLANK, _ASCII, _LEAD, _MORE = range(4)
_CLASS = np.full(256, _ASCII, dtype=np.uint8)
_CLASS[0xC0:] = _LEAD
_CLASS[0x80:0xC0] = _MORE
_CLASS[SEPARATORS] = _BLANK
_ENDS = [2 * c + 1 for c in (_BLANK, _ASCII, _LEAD, _MORE)]
_CONTINUED = [2 * _MORE, 2 * _MORE + 1]


@dataclass(frozen=True)
class FimConfig:
    """``rate`` per cent of the texts are rearranged, ``spm_rate`` per cent of these with the suffix first."""

    seed: int = 42
    rate: int = 50
    spm_rate: int = 80


class BitRank:
    """Bits with the number of ones before every 64th."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) // 64 + 1) * 8, dtype=np.uint8)
        packed[: (len(bits) + 7) // 8] = np.packbits(bits, bitorder="little")
        self.words = packed.view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.cumsum(ones, dtype=np.int64) - ones

    def ones(self, at: np.ndarray) -> np.ndarray:
        """The number of ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Rank over a sequence of symbols below 8: one row of bits per binary digit, sorted stably by the digit before the next."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[tuple[int, BitRank, int]] = []
        rest = symbols
        for digit in reversed(range(_LEVELS)):
            bits = (rest >> digit) & 1 == 1
            self.levels.append((digit, BitRank(bits), len(rest) - int(np.count_nonzero(bits))))
            rest = np.concatenate([rest[~bits], rest[bits]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before each position."""
        first, at = np.zeros(1, dtype=np.int64), np.asarray(at, dtype=np.int64)
        for digit, bits, zeros in self.levels:
            if symbol >> digit & 1:
                first, at = zeros + bits.ones(first), zeros + bits.ones(at)
            else:
                first, at = first - bits.ones(first), at - bits.ones(at)
        return at - first

    def ranks(self, symbols: list[int], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, at) for s in symbols)


def symbols_of(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The symbol of every byte of texts that lie one after the other between ``bounds``."""
    classes = _CLASS[data]
    ends = np.zeros(len(data), dtype=np.uint8)
    ends[:-1] = (classes[:-1] != _BLANK) & (classes[1:] == _BLANK)
    # Nothing crosses from one text into the next.
    last = bounds[1:][np.diff(bounds) > 0] - 1
    ends[last] = 1
    return 2 * classes + ends


def unit_cuts(matrix: WaveletMatrix, low: np.ndarray, high: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The place behind the given number of units of every text, which lies between ``low`` and ``high``, by bisection on ranks."""
    wanted = matrix.ranks(_ENDS, low) + units
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        short = matrix.ranks(_ENDS, middle) < wanted
        low = np.where(open_ & short, middle + 1, low)
        high = np.where(open_ & ~short, middle, high)
    return low


_DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _made(data: np.ndarray, bounds: np.ndarray, h1: np.ndarray, h2: np.ndarray, form: list[str]) -> tuple[np.ndarray, list, list, pa.Array]:
    """(units, prefix and middle length in characters, output) of the texts of a chunk."""
    matrix = WaveletMatrix(symbols_of(data, bounds))
    starts, ends = bounds[:-1], bounds[1:]
    units = matrix.ranks(_ENDS, ends) - matrix.ranks(_ENDS, starts)
    one, two = h1 % (units + 1), h2 % (units + 1)
    cut_1 = unit_cuts(matrix, starts, ends, np.minimum(one, two))
    cut_2 = unit_cuts(matrix, starts, ends, np.maximum(one, two))
    place = [at - matrix.ranks(_CONTINUED, at) for at in (starts, cut_1, cut_2)]
    plain = np.array([f == "plain" for f in form])
    whole = data.tobytes()
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    out = []
    for f, a, b, c, d in zip(form, starts.tolist(), cut_1.tolist(), cut_2.tolist(), ends.tolist()):
        if f == "plain":
            out.append(whole[a:d])
        elif f == "psm":
            out.append(b"".join([marks[0], whole[a:b], marks[1], whole[c:d], marks[2], whole[b:c]]))
        else:
            out.append(b"".join([marks[1], whole[c:d], marks[0], whole[a:b], marks[2], whole[b:c]]))
    chars = [pa.array(place[i + 1] - place[i], mask=plain) for i in range(2)]
    # The bytes are those of the text in another order; they are handed on without another check.
    return units, chars[0], chars[1], pa.array(out, pa.binary()).view(pa.string())


def fill_in_middle(docs: DataFrame, config: FimConfig = FimConfig()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of (doc_id, text).

    ``n`` is the number of units. ``form`` is plain (the text), psm (prefix, suffix, middle) or spm (suffix, prefix,
    middle); the two lengths are in characters, null for plain.
    """
    h = [F.conv(F.substring("_hash", 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)]
    hashed = texts(docs).select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.sha2(F.concat(F.lit(f"{config.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("_hash"),
    )
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (F.col("_h3") % 100 >= config.rate)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < config.spm_rate, "spm").otherwise("psm")
    rows = hashed.select("doc_id", "text", *h).select("doc_id", "text", "_h1", "_h2", form.alias("form"))

    def cut(frames: Iterable[pa.RecordBatch]):
        for frame in frames:
            data, offsets = buffers(frame.column("text"))
            h1, h2 = (frame.column(name).to_numpy(zero_copy_only=False) for name in ("_h1", "_h2"))
            form = frame.column("form")
            for first, last in chunk_bounds(offsets, _CHUNK_BYTES):
                here = slice(first, last)
                bounds = offsets[first : last + 1] - offsets[first]
                part = data[offsets[first] : offsets[last]]
                units, before, middle, output = _made(part, bounds, h1[here], h2[here], form[here].to_pylist())
                columns = [frame.column("doc_id")[here], pa.array(units), form[here], before, middle, output]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(cut, _DDL)


def restore(output: Column, form: Column) -> Column:
    """The text, from an output and its form.

    A rearranged text holds no sentinel of its own, and none can arise at a seam, as only the first
    character of a sentinel is "<"; so the three sentinels split the output.
    """
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
