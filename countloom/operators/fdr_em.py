"""Two-component mixture over evidence scores, fitted by EM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.functions.vectors import clamp
from countloom.storage import materialise

# The probability guard, the bounds of the prior, and the decrease that stops the loop.
PROB_EPS = 1e-10
PRIOR_LOW, PRIOR_HIGH = 0.1, 0.9
DECREASE = -1e-10


@dataclass(frozen=True)
class MixtureFit:
    prior_prob: float
    log_likelihood: float
    converged: bool
    n_iterations: int


def evidence(score: str = "score") -> Column:
    """Logistic transform of the score, kept off 0 and 1."""
    return clamp(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(score))), PROB_EPS, 1 - PROB_EPS)


def responsibility(b: str, prior: float) -> Column:
    """Posterior probability of the first component for evidence ``b`` at the given prior."""
    p = min(max(prior, PRIOR_LOW), PRIOR_HIGH)
    odds = F.col(b) / (F.lit(1.0) - F.col(b)) * F.lit(p / (1.0 - p))
    return clamp(odds / (F.lit(1.0) + odds), PROB_EPS, 1 - PROB_EPS)


def em_step(scored: DataFrame, prior: float) -> DataFrame:
    """One row: mean responsibility and log-likelihood at the given prior."""
    q = responsibility("b", prior)
    loglik = q * F.log("b") + (F.lit(1.0) - q) * F.log(F.lit(1.0) - F.col("b"))
    return scored.agg(F.avg(q).alias("mean_q"), F.sum(loglik).alias("loglik"))


def next_prior(prior: float, mean_q: float) -> float:
    """Half-way update of the prior, kept within its bounds."""
    return min(max((prior + mean_q) / 2.0, PRIOR_LOW), PRIOR_HIGH)


def fit_mixture(
    scores: DataFrame, max_iter: int = 100, tolerance: float = 1e-4, initial_p: float = 0.5
) -> tuple[DataFrame, MixtureFit]:
    """Fit the mixture; returns the scores with ``posterior_prob`` and the fit's summary.

    The only parameter is one number, so an iteration is one aggregate over the
    scores. The best iteration is returned; the loop ends when the likelihood
    falls or gains less than ``tolerance``.
    """
    scored = materialise(scores.withColumn("b", evidence()), "scores")
    prior, previous, best = initial_p, None, None
    converged, iterations = False, max_iter
    for i in range(max_iter):
        row = em_step(scored, prior).first()
        updated = next_prior(prior, row["mean_q"])
        if best is None or row["loglik"] > best[2]:
            best = (prior, updated, row["loglik"])
        prior = updated
        if previous is not None and row["loglik"] - previous < max(tolerance, DECREASE):
            converged, iterations = True, i
            break
        previous = row["loglik"]
    at, fitted, loglik = best
    out = scored.select(*scores.columns, responsibility("b", at).alias("posterior_prob"))
    return out, MixtureFit(fitted, loglik, converged, iterations)
