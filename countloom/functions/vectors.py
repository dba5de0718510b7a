"""Small fixed-length vectors (one slot per factor) in array columns."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def total(terms: list[Column]) -> Column:
    return reduce(add, terms)


def dot(left: Column, right: Column, size: int) -> Column:
    """Inner product of two arrays of known length; plain arithmetic, so it is code-generated."""
    return total([left[i] * right[i] for i in range(size)])


def pack(df: DataFrame, key: str, index: str, value: str, size: int, name: str) -> DataFrame:
    """Long rows (key, index, value) to one array per key; absent slots are 0.

    Hash aggregation over ``size`` plain columns, combined on the map side.
    """
    slots = [F.max(F.when(F.col(index) == i, F.col(value))).alias(f"_s{i}") for i in range(size)]
    packed = F.array(*[F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) for i in range(size)])
    return df.groupBy(key).agg(*slots).select(key, packed.alias(name))


def unpack(df: DataFrame, keys: list[str], array: str, index: str, value: str) -> DataFrame:
    """One array per row to long rows (keys, index, value)."""
    return df.select(*keys, F.posexplode(array).alias(index, value))


def hashed_order(*parts) -> Column:
    """A seeded pseudo-random sort key that depends on the row's values only.

    Unlike ``rand`` it gives the same result under any partitioning and any
    retry of a task.
    """
    return F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))
