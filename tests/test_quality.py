import numpy as np
import pandas as pd
import pytest
from data import long_samples

from countloom.operators import fdr_em, quality


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 5)) + np.repeat(np.eye(3, 5) * 2, 30, axis=0)
    labels = np.repeat([0, 1, 2], 30)
    labels[0] = 7
    rows = [(i, int(labels[i]), x[i].tolist()) for i in range(90)]
    return spark.createDataFrame(rows, "cell_id long, label int, coords array<double>"), x, labels


def _brute(x, labels, power):
    d = np.linalg.norm(x[:, None] - x[None], axis=2) ** power
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == other].mean() for other in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b))
    return out


def test_silhouette(clouds):
    points, x, labels = clouds
    want = _brute(x, labels, 1)
    for block in (20_000, 20):
        rows = quality.silhouette_cells(points, rows_per_block=block).orderBy("cell_id").collect()
        assert [r.silhouette for r in rows] == pytest.approx(want, abs=1e-6)
    assert quality.silhouette_score(quality.silhouette_cells(points)).first().silhouette == pytest.approx(np.mean(want))


def test_silhouette_squared(clouds):
    points, x, labels = clouds
    rows = quality.silhouette_squared_cells(points, 5).orderBy("cell_id").collect()
    assert [r.silhouette for r in rows] == pytest.approx(_brute(x, labels, 2))


def test_run_correlation(spark):
    rng = np.random.default_rng(8)
    base = rng.dirichlet([1] * 3, 50)
    runs = [base, base[:, [2, 0, 1]], rng.dirichlet([1] * 3, 50)]
    phi = pd.concat([long_samples(r, ["cell_id", "factor_idx"], "phi").assign(run_id=i) for i, r in enumerate(runs)])
    df = spark.createDataFrame(phi)
    for r in quality.factor_correlations(df, 3).collect():
        want = np.corrcoef(runs[r.run_a][:, r.factor_a], runs[r.run_b][:, r.factor_b])[0, 1]
        assert r["corr"] == pytest.approx(want)
    matched = {(r.run_a, r.run_b): r["corr"] for r in quality.run_correlation(df, 3).collect()}
    assert matched[1, 0] == pytest.approx(1.0) and len(matched) == 3
    stats = quality.pairwise_stats(quality.run_correlation(df, 3)).first()
    values = list(matched.values())
    assert (stats.average, stats.median, stats.minimum) == pytest.approx((np.mean(values), np.median(values), min(values)))


def test_mixture_golden(spark):
    scores = spark.createDataFrame([(i, float(s)) for i, s in enumerate([-5, -1, 0, 1, 5, 10])], "junction_id long, score double")
    out, fit = fdr_em.fit_mixture(scores)
    rows = [r.posterior_prob for r in out.orderBy("junction_id").collect()]
    assert rows == pytest.approx([0.006693, 0.268941, 0.5, 0.731059, 0.993307, 0.999955], abs=1e-6)
    assert fit.prior_prob == pytest.approx(0.541663, abs=1e-6)
    assert fit.log_likelihood == pytest.approx(-1.938412, abs=1e-6)
    assert fit.converged and fit.n_iterations == 1


def test_mixture_limits(spark):
    scores = spark.createDataFrame([(0, 3.0), (1, 4.0)], "junction_id long, score double")
    _, one = fdr_em.fit_mixture(scores, max_iter=1)
    assert not one.converged and one.n_iterations == 1
    assert fdr_em.next_prior(0.9, 1.0) == 0.9 and fdr_em.next_prior(0.1, 0.0) == 0.1
