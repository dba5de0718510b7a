"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns that every pipeline stage but the last returns.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Fixed value: the pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Id and text under names of our own, so that further columns cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def text_key() -> Column:
    """With the id, this tells rows apart; rows equal in both are copies with equal results."""
    return F.xxhash64("text")


def held(remainder: int, of: int = 5) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == remainder, F.lit(False))


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_slice(start: Column, words: Column) -> Column:
    """``words`` words of the column text from word ``start`` on, each with the separators that follow it.

    Slices that follow one another therefore join to the whole text.
    """
    blank = WORD.replace("[^", "[")
    parts = F.regexp_extract_all("text", F.lit(f"(?:^{blank})?{WORD}{blank.replace('+', '*')}"), F.lit(0))
    part = F.array_join(F.slice(parts, (start + 1).cast("int"), words.cast("int")), "")
    whole = (start == 0) & (words == F.regexp_count("text", F.lit(WORD)))
    return F.when(whole, F.col("text")).otherwise(part)
