"""Small inputs with known results."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Six cells, five junctions in ATSEs of two and three; the mean of junction 0 is exactly 2.
WORKED_Y = [[5, 0, 2, 1, 0], [0, 8, 0, 0, 7], [1, 1, 6, 0, 2], [2, 0, 0, 3, 3], [0, 3, 0, 8, 1], [4, 2, 0, 1, 0]]
WORKED_ATSE = [0, 0, 1, 1, 1]


def long_counts(matrix, atse):
    m = np.asarray(matrix)
    c, j = np.nonzero(m)
    return pd.DataFrame(
        {
            "cell_id": c.astype("int64"),
            "junction_id": j.astype("int64"),
            "atse_id": np.asarray(atse)[j].astype("int64"),
            "y": m[c, j].astype(float),
        }
    )


def tables(spark, matrix, atse):
    """(counts, cells, junctions) of a dense matrix."""
    n_cells, n_junctions = np.asarray(matrix).shape
    counts = spark.createDataFrame(long_counts(matrix, atse))
    cells = spark.createDataFrame([(i,) for i in range(n_cells)], "cell_id long")
    junctions = spark.createDataFrame([(j, int(atse[j])) for j in range(n_junctions)], "junction_id long, atse_id long")
    return counts, cells, junctions


def synthetic(n_cells=30, n_junctions=60, per_atse=4, seed=1):
    """Counts that fade over the junctions of an ATSE; every junction has an entry."""
    rng = np.random.default_rng(seed)
    rate = 0.15 + 1.2 / (1 + np.arange(n_junctions) % per_atse)
    y = rng.negative_binomial(2, 2 / (2 + rate), (n_cells, n_junctions))
    y[np.arange(n_junctions) % n_cells, np.arange(n_junctions)] += 1
    return y, np.arange(n_junctions) // per_atse


def planted(n_cells=300, n_junctions=40, k=3, seed=3):
    """Counts from block factors: entries, psi and phi."""
    rng = np.random.default_rng(seed)
    psi = np.where(rng.random((k, n_junctions)) < 0.5, 0.1, 0.9)
    phi = rng.dirichlet([0.3] * k, n_cells)
    n = rng.poisson(6, (n_cells, n_junctions))
    y = rng.binomial(n, phi @ psi)
    c, j = np.nonzero(n)
    entries = pd.DataFrame(
        {
            "cell_id": c.astype("int64"),
            "junction_id": j.astype("int64"),
            "y": y[c, j].astype(float),
            "n": n[c, j].astype(float),
        }
    )
    return entries, psi, phi


def long_samples(array, names, value):
    """A dense array to long rows, one column per axis."""
    index = np.indices(array.shape).reshape(array.ndim, -1)
    frame = {name: axis.astype("int64") for name, axis in zip(names, index)}
    return pd.DataFrame({**frame, value: array.ravel().astype(float)})


def dense(df, row, column, value):
    return df.toPandas().pivot(index=row, columns=column, values=value).to_numpy()
