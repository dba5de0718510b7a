"""Fewer rows in a shuffle: a bounded bit table of the ids that a join can meet.

Texts are by far the largest column, so a join that needs few of them should not shuffle all. The table has a fixed size
whatever the number of ids; with many ids it lets more rows through and never turns one away wrongly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25
_HASHES = 3


def _places(column: str = "doc_id"):
    return [F.pmod(F.xxhash64(F.lit(k), F.col(column)), F.lit(BITS)) for k in range(_HASHES)]


def split_by_ids(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` whose ``doc_id`` may be among ``ids``, and those whose id is certainly not."""
    places = ids.select(F.explode(F.array(*_places())).alias("p"))
    words = places.selectExpr("cast(p div 64 as int) AS word", "shiftleft(1L, cast(pmod(p, 64) as int)) AS bit")
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(BITS // 64, np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table.view(np.uint8))

    @F.pandas_udf("boolean")
    def may_be(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        bits = shared.value
        for columns in parts:
            out = np.ones(len(columns[0]), bool)
            for column in columns:
                p = column.to_numpy()
                out &= (bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
            yield pd.Series(out)

    marked = docs.withColumn("_may_be", may_be(*_places()))
    return marked.filter("_may_be").drop("_may_be"), marked.filter("NOT _may_be").drop("_may_be")
