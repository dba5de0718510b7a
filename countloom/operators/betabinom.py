"""Maximum likelihood of a beta-binomial intercept for every junction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.functions.special import digamma, lgamma, trigamma


# A concentration beyond this is a binomial: the likelihood has no finite maximum.
_NO_MAXIMUM = 1e5


def value_counts(obs: DataFrame) -> DataFrame:
    """(junction_id, part, value, times): how often each y, n - y and n occurs.

    The beta-binomial likelihood is a sum over y, over n - y and over n
    separately, so these three histograms are sufficient. A junction with d
    distinct values needs at least d^2 / 2 reads, so they stay small.
    """
    parts = F.array(
        F.struct(F.lit("y").alias("part"), F.col("y").alias("value")),
        F.struct(F.lit("f").alias("part"), (F.col("n") - F.col("y")).alias("value")),
        F.struct(F.lit("n").alias("part"), F.col("n").alias("value")),
    )
    rows = obs.filter(F.col("n") > 0).select("junction_id", F.inline(parts))
    return rows.groupBy("junction_id", "part", "value").agg(F.count(F.lit(1)).alias("times"))


def _solve(parts: pd.DataFrame, max_iter: int, tol: float) -> tuple[float, float, float, bool, int]:
    split = {name: g for name, g in parts.groupby("part")}
    arrays = {name: (g["value"].to_numpy(float), g["times"].to_numpy(float)) for name, g in split.items()}
    (y, wy), (f, wf), (n, wn) = arrays["y"], arrays["f"], arrays["n"]
    total = wn.sum()

    def loglik(a, b):
        rising = lambda v, w, s: (w * (lgamma(v + s) - lgamma(s))).sum()
        return rising(y, wy, a) + rising(f, wf, b) - rising(n, wn, a + b)

    mean = np.clip((y * wy).sum() / (n * wn).sum(), 1e-3, 1 - 1e-3)
    a, b = 10.0 * mean, 10.0 * (1 - mean)
    best, converged = loglik(a, b), False
    for _ in range(max_iter):
        s = a + b
        first = lambda v, w, p: (w * (digamma(v + p) - digamma(p))).sum()
        second = lambda v, w, p: (w * (trigamma(v + p) - trigamma(p))).sum()
        ga, gb = first(y, wy, a) - first(n, wn, s), first(f, wf, b) - first(n, wn, s)
        hs = second(n, wn, s)
        grad = np.array([a * ga, b * gb])
        hess = np.array(
            [
                [a * a * (second(y, wy, a) - hs) + a * ga, -a * b * hs],
                [-a * b * hs, b * b * (second(f, wf, b) - hs) + b * gb],
            ]
        )
        values, basis = np.linalg.eigh(hess)
        step = basis @ ((basis.T @ grad) / np.maximum(np.abs(values), 1e-8))
        step = np.clip(step, -2, 2)
        scale = 1.0
        while scale > 1e-6:
            na, nb = a * np.exp(scale * step[0]), b * np.exp(scale * step[1])
            value = loglik(na, nb)
            if value >= best:
                break
            scale /= 2
        else:
            converged = a + b <= _NO_MAXIMUM
            break
        gain = value - best
        a, b, best = na, nb, value
        if gain <= tol * max(1.0, abs(best)) or a + b > _NO_MAXIMUM:
            converged = a + b <= _NO_MAXIMUM
            break
    return a, b, best, converged, int(total)


def fit_alpha_beta(obs: DataFrame, max_iter: int = 100, tol: float = 1e-12) -> DataFrame:
    """(junction_id, alpha, beta, loglik, converged, n_obs); loglik without the ln C(n, y) terms.

    Underdispersed data have no finite maximum; such rows have converged = false.
    """
    id_type = dict(obs.dtypes)["junction_id"]

    def solve(parts: pd.DataFrame) -> pd.DataFrame:
        alpha, beta, loglik, converged, n_obs = _solve(parts, max_iter, tol)
        return pd.DataFrame(
            {
                "junction_id": [parts["junction_id"].iloc[0]],
                "alpha": [alpha],
                "beta": [beta],
                "loglik": [loglik],
                "converged": [converged],
                "n_obs": [n_obs],
            }
        )

    schema = f"junction_id {id_type}, alpha double, beta double, loglik double, converged boolean, n_obs long"
    return value_counts(obs).groupBy("junction_id").applyInPandas(solve, schema)
