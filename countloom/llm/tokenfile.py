"""Token ids as Parquet list columns that can be read selectively.

Documents are put in ascending order of their ids by a range partitioning, encoded, and written as one file per range: columns
part, doc_id, start, n_tokens and ids, in that order of rows. ``start`` counts the ids of the same part before the
document; a manifest with one row per part holds the ids before the part, so no second pass over the ids is needed to number
them. The format is controlled by the writer's options:

* ids are dictionary encoded (a vocabulary fits one dictionary page, and a row group repeats it), the integer columns are
  delta encoded;
* row groups hold a bounded number of bytes, pages a bounded number of rows and bytes;
* column and offset indexes are written, and rows are sorted, so a filter on doc_id, part or start reads the pages it needs.

Metadata are read without touching the ids. A range of global token positions is read from the parts that hold it.

White space separates words for the tokenizer, so a text's ids are those of its words one after the other. Each distinct word is
encoded by the library once and kept; the tables are emptied when they hold ``kept_words`` and ``kept_pieces``. If the tokenizer
composes, lower-cases and splits by the pattern below, as the public one does, words of Latin letters, digits and ASCII signs are
split here, so that only their distinct pieces are given to the library's model; all other words go through the whole library.

Results: one row per row of the input. A null text counts as empty and holds the end id alone. Null ids come last; rows with
equal ids are ordered by the hash of their texts, so equal rows are neighbours.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countloom.llm.tables import text_key, texts
from countloom.llm.text import buffers, chunk_bounds

#: Words longer than this are encoded where they occur and not kept.
_LONG_WORD = 64
#: The pattern of a tokenizer whose Latin words may be split here, and the steps before it.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STEPS = ["NFC", "Replace", "Lowercase"]
#: Letters of Latin-1; they are composed, and each has one lower-case form.
_LETTERS = "a-z\xdf-\xf6\xf8-\xff"
#: Of words joined by spaces: those with a character that is none of these, or with "<", as they may hold a token of its own.
_OTHER_WORD = re.compile(f"(?<![^ ])[!-;=-~{_LETTERS}\xc0-\xd6\xd8-\xde]*[^ !-;=-~{_LETTERS}\xc0-\xd6\xd8-\xde][^ ]*")
_LATIN_PIECE = re.compile(f" |'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ {_LETTERS}0-9]+")
#: Stands between the ids of two words; as the last byte of an id is 0, no bytes of ids look like it.
_GAP = b"\xff" * 4


@dataclass(frozen=True)
class TokenFileConfig:
    """``tokenizer`` is the path of a tokenizers file for which white space separates words."""

    tokenizer: str
    end_id: int = 1
    row_group_bytes: int = 16 << 20
    page_bytes: int = 64 << 10
    page_rows: int = 1000
    kept_words: int = 150_000
    kept_pieces: int = 500_000


_FILE_DDL = "part int, doc_id long, start long, n_tokens long, ids array<int>"


def _options(config: TokenFileConfig) -> dict[str, str]:
    """Settings of the Parquet writer; the second page version delta-encodes integers that have no dictionary."""
    plain = {f"parquet.enable.dictionary#{name}": "false" for name in ("part", "doc_id", "start", "n_tokens")}
    return plain | {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        "parquet.block.size": str(config.row_group_bytes),
        "parquet.page.size": str(config.page_bytes),
        "parquet.page.row.count.limit": str(config.page_rows),
        "compression": "zstd",
    }


def _splits_latin_words(tokenizer) -> bool:
    """Whether the tokenizer's own description says that it splits words by the pattern above and nothing else."""
    told = json.loads(tokenizer.to_str())
    before = (told.get("normalizer") or {}).get("normalizers", [])
    cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [step["type"] for step in before] == _STEPS
        and [step["type"] for step in cuts] == ["Split", "ByteLevel"]
        and (cuts[0]["pattern"].get("Regex"), cuts[0]["behavior"], cuts[0]["invert"]) == (_PIECES, "Removed", True)
        and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"])
        and all("<" in added["content"] for added in told["added_tokens"])
    )


class WordEncoder:
    """Ids of texts, by the ids of their distinct words."""

    def __init__(self, config: TokenFileConfig):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limits = Tokenizer.from_file(config.tokenizer), (config.kept_words, config.kept_pieces)
        self.end = np.uint32(config.end_id).tobytes()
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.latin = _splits_latin_words(self.tokenizer) and self.tokenizer.get_vocab_size() < 1 << 24
        # How the library writes the bytes of a letter.
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {c: spelled.pre_tokenize_str(chr(c))[0][0] for c in [*range(0x21, 0x7F), *range(0xDF, 0x100)]}

    def _latin_ids(self, words: str) -> list[bytes]:
        """The ids of each of the lower-case Latin words, joined by spaces, which are split all at once."""
        found = _LATIN_PIECE.findall(words)
        pieces = self.pieces
        tokenize = self.tokenizer.model.tokenize
        for piece in set(found).difference(pieces):
            # ASCII signs are spelled as they are.
            ids = [token.id for token in tokenize(piece if piece.isascii() else piece.translate(self.spelling))]
            pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)
        pieces[" "] = _GAP
        return b"".join(map(pieces.__getitem__, found)).split(_GAP)

    def _learn(self, words: list[bytes], out: dict[bytes, bytes], latin: bool) -> None:
        """Adds the ids of distinct words without white space to ``out``; with ``latin`` those of Latin letters are split here."""
        whole = b" ".join(words).decode("utf-8", "replace")
        texts, others = whole.split(" "), None
        if latin:
            other, others = set(_OTHER_WORD.findall(whole)), []
            if other:
                others = [(word, text) for word, text in zip(words, texts) if text in other]
                words = [word for word, text in zip(words, texts) if text not in other]
                whole = " ".join([text for text in texts if text not in other])
            if words:
                out.update(zip(words, self._latin_ids(whole.lower())))
        if others is None:
            others = list(zip(words, texts))
        found = self.tokenizer.encode_batch([text for _, text in others], add_special_tokens=False) if others else []
        out.update((word, np.array(e.ids, dtype="<u4").tobytes()) for (word, _), e in zip(others, found))

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The ids of texts that lie one after the other, as bytes, each with the end id."""
        whole = data.tobytes()
        split = [whole[a:b].split() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for kept, limit in zip((self.known, self.pieces), self.limits):
            if len(kept) > limit:
                kept.clear()
        known = self.known
        missing = set(chain.from_iterable(split)).difference(known)
        long_words = [w for w in missing if len(w) > _LONG_WORD] if missing and max(map(len, missing)) > _LONG_WORD else []
        missing.difference_update(long_words)
        if missing:
            self._learn(list(missing), known, self.latin)
        if long_words:
            known = known.copy()
            self._learn(long_words, known, False)
        return [b"".join([*map(known.__getitem__, words), self.end]) for words in split]


def _worker_encoder(config: TokenFileConfig) -> WordEncoder:
    """One encoder per Python worker.

    This module arrives anew with every task, so the encoder is kept with the library's module, which stays.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_countloom_encoders", {})
    key = tuple(vars(config).values())
    if key not in kept:
        kept.clear()
        kept[key] = WordEncoder(config)
    return kept[key]


def _id_list(encoded: list[bytes]) -> tuple[np.ndarray, pa.ListArray]:
    """(number of ids, ids as an Arrow list column)."""
    sizes = np.array([len(e) // 4 for e in encoded], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = np.frombuffer(b"".join(encoded), dtype=np.int32)
    return sizes, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def write_tokens(docs: DataFrame, path: str, config: TokenFileConfig) -> None:
    """Encode every text of (doc_id, text) and write the token files and their manifest under ``path``."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_key").asc()]
    ordered = texts(docs).withColumn("text_key", text_key()).repartitionByRange(*order).sortWithinPartitions(*order)

    def encode(frames: Iterable[pa.RecordBatch]):
        encoder, part, start = _worker_encoder(config), TaskContext.get().partitionId(), 0
        for frame in frames:
            data, offsets = buffers(frame.column("text"))
            for first, last in chunk_bounds(offsets):
                bounds = offsets[first : last + 1] - offsets[first]
                sizes, ids = _id_list(encoder.encode(data[offsets[first] : offsets[last]], bounds))
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                columns = [pa.array(np.full(last - first, part, np.int32)), frame.column("doc_id")[first:last], pa.array(starts), pa.array(sizes), ids]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "start", "n_tokens", "ids"])

    spark = docs.sparkSession
    ordered.select("doc_id", "text").mapInArrow(encode, _FILE_DDL).write.options(**_options(config)).parquet(f"{path}/tokens")
    per_part = token_rows(spark, path).groupBy("part").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("part_tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )
    # One row per file; ranges are numbered in the order of the ids.
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part.withColumn("tokens_before", F.coalesce(F.sum("part_tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/manifest")


def token_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the token files; ``start`` counts within the part."""
    return spark.read.schema(_FILE_DDL).parquet(f"{path}/tokens")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(part, n_docs, part_tokens, first_id, last_id, tokens_before), one row per token file."""
    return spark.read.schema(
        "part int, n_docs long, part_tokens long, first_id long, last_id long, tokens_before long"
    ).parquet(f"{path}/manifest")


def _numbered(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """The rows with ``start`` counted over all parts."""
    offsets = manifest(spark, path).select("part", "tokens_before")
    return rows.join(offsets, "part").withColumn("start", F.col("start") + F.col("tokens_before")).drop("part", "tokens_before")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) of every document; the ids are not read."""
    return _numbered(token_rows(spark, path).drop("ids"), spark, path)


def read_documents(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, or of those with ids from ``first_id`` to ``last_id``."""
    rows = token_rows(spark, path)
    if first_id is not None:
        rows = rows.filter(F.col("doc_id") >= first_id)
    if last_id is not None:
        rows = rows.filter(F.col("doc_id") <= last_id)
    return _numbered(rows, spark, path)


def read_span(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """(doc_id, start, ids) of the global token positions ``first`` to ``first + count - 1``, cut to these."""
    last = first + count
    held = manifest(spark, path).filter((F.col("tokens_before") < last) & (F.col("tokens_before") + F.col("part_tokens") > first))
    rows = token_rows(spark, path).join(held.select("part", "tokens_before"), "part")
    begin = F.col("start") + F.col("tokens_before")
    rows = rows.filter((begin < last) & (begin + F.col("n_tokens") > first))
    skip = F.greatest(F.lit(first) - begin, F.lit(0)).cast("int")
    take = (F.least(begin + F.col("n_tokens"), F.lit(last)) - begin).cast("int") - skip
    return rows.select("doc_id", (begin + skip).alias("start"), F.slice("ids", skip + 1, take).alias("ids"))


def with_crc32(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the checksum of the ids as little-endian unsigned 32-bit integers."""

    def checked(frames: Iterable[pa.RecordBatch]):
        for frame in frames:
            ids = frame.column("ids")
            offsets = ids.offsets.to_numpy() - ids.offsets[0].as_py() if len(ids) else np.zeros(1, np.int64)
            data = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), dtype="<i4").view(np.uint8))
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            columns = [frame.column("doc_id"), frame.column("start"), frame.column("n_tokens"), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(checked, "doc_id long, start long, n_tokens long, ids_crc32 long")
