"""Compare a registered query with its SQL on the same parquet tables."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _key(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, float(value))
    return (3, str(value))


def _same(x, y) -> bool:
    """Equal, or apart by one unit of the sixth decimal: an exact tie may round either way."""
    if isinstance(x, float) and isinstance(y, float) and not (math.isnan(x) or math.isnan(y)):
        return abs(x - y) <= 1.01e-6
    return _key(x) == _key(y)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(picked, key=lambda r: tuple(_key(v) for v in r))


def difference(spark_df, con, sql) -> str | None:
    """None if equal, else a short description of the first difference."""
    names, got = sorted_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    want_names, want = sorted_rows([d[0] for d in result.description], result.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if not all(_same(x, y) for x, y in zip(a, b)):
            return f"{a} != {b}"
    return None
