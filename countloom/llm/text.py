"""Words of Arrow text batches as numpy arrays of 64-bit hashes.

A word is a run of bytes other than space and tab to carriage return. All of
these are single bytes in UTF-8, so texts can be cut without decoding them. The
functions here work on whole texts, a few hundred kilobytes at a time, so their
memory is bounded by the chunk and the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 512 * 1024
#: The separators of words, and odd multipliers of the hashes.
SEPARATORS = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[SEPARATORS] = False
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = _byte_values(11)
_VALUE_LOWER = _VALUE[_LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """``hash`` of every word; words ``offsets[i]`` to ``offsets[i + 1]`` belong to text i of the chunk."""

    hash: np.ndarray
    offsets: np.ndarray
    first: int
    last: int

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.last - self.first), self.counts)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), offsets


def chunk_bounds(offsets: np.ndarray, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``chunk_bytes`` each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + chunk_bytes, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def locate(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word mask, starts, ends, words before each text) of texts that lie one after the other."""
    inside = _IS_WORD[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # A text ends a word even where the next text begins with one.
    edges = np.unique(bounds[(bounds > 0) & (bounds < len(data))])
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(starts)
    return inside, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, bounds)


def hash_runs(values: np.ndarray, lengths: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Polynomial hash of consecutive runs of ``values``; every length is at least 1."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    begins = np.cumsum(lengths) - lengths
    within = np.arange(len(values)) - np.repeat(begins, lengths)
    sums = np.add.reduceat(values * powers(base, int(lengths.max()))[within], begins)
    return mix(sums + lengths.astype(np.uint64))


def word_chunks(column: pa.Array, lower: bool, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """The hashed words of a string column, chunk by chunk; ``lower`` folds A-Z."""
    data, offsets = buffers(column)
    table = _VALUE_LOWER if lower else _VALUE
    for first, last in chunk_bounds(offsets, chunk_bytes):
        part = data[offsets[first] : offsets[last]]
        inside, starts, ends, words = locate(part, offsets[first : last + 1] - offsets[first])
        yield Words(hash_runs(table[part[inside]], ends - starts), words, first, last)


def rolling(hashes: np.ndarray, width: int, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of every ``width`` consecutive values; element i covers i to i + width - 1."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= base
        out += hashes[k : k + n]
    return mix(out)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def batches(frame: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([column for _, column in frame], names=[name for name, _ in frame])
