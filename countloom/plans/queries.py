"""The registered queries: a Spark plan per operator, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.functions import draws
from countloom.functions.vectors import pack
from countloom.operators import betabinom, fdr_em, likelihood, posterior, quality
from countloom.operators import counts as C
from countloom.operators import differential as D
from countloom.operators import fit as M
from countloom.operators import summaries as S
from countloom.operators import waypoints as W
from countloom.plans import inputs as I
from countloom.plans import lifecycles
from countloom.plans import sql as Q
from countloom.sources import dataset as IO
from countloom.sources import gtf
from countloom.storage import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded half away from zero, so that the order of summation does not show.

    Plain arithmetic rather than ``round``, which goes through decimals.
    """
    scale = float(10**digits)

    def near(c: str):
        return (F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale).alias(c)

    return df.select(*[near(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, name: str | None = None):
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


BASE = (Q.PURCHASES, Q.COUNTS, Q.OBS)


def _obs(spark, sf):
    return C.with_totals(I.counts(spark, sf))


# ---- counts, totals, ratios ---------------------------------------------------------------


@query(Q.with_ctes(*BASE) + "SELECT cell_id, atse_id, junction_id, y, n FROM obs")
def atse_totals(spark, sf):
    return _obs(spark, sf).select("cell_id", "atse_id", "junction_id", "y", "n")


@query(
    Q.with_ctes(*BASE, Q.JUNCTIONS)
    + """SELECT t.cell_id, j.junction_id, t.n
         FROM (SELECT cell_id, atse_id, sum(y) AS n FROM counts GROUP BY cell_id, atse_id) t
         JOIN junctions j USING (atse_id)"""
)
def cluster_layer(spark, sf):
    layer = C.cluster_layer(C.atse_totals(I.counts(spark, sf)), I.junctions(spark, sf))
    return layer.select("cell_id", "junction_id", "n")


@query(
    Q.with_ctes(*BASE)
    + """, totals AS (SELECT cell_id, atse_id, sum(y) AS n FROM counts GROUP BY cell_id, atse_id)
    SELECT c.cell_id, c.junction_id, c.y, coalesce(t.n, CAST(0 AS DOUBLE)) AS n
    FROM counts c LEFT JOIN totals t ON c.cell_id = t.cell_id AND c.atse_id = t.atse_id"""
)
def observed_entries(spark, sf):
    """Alignment of the layers."""
    counts = I.counts(spark, sf)
    totals = C.atse_totals(counts)
    data = C.Dataset(
        I.cells(spark, sf),
        I.junctions(spark, sf),
        {C.JUNCTION_LAYER: counts.drop("atse_id"), C.CLUSTER_LAYER: totals},
    )
    return C.observed_entries(data).select("cell_id", "junction_id", "y", "n")


@query(
    Q.with_ctes(*BASE, Q.JUNCTIONS)
    + """SELECT t.cell_id, j.junction_id, coalesce(c.y, CAST(0 AS DOUBLE)) AS y, t.n
         FROM (SELECT cell_id, atse_id, sum(y) AS n FROM counts GROUP BY cell_id, atse_id) t
         JOIN junctions j USING (atse_id)
         LEFT JOIN counts c ON c.cell_id = t.cell_id AND c.junction_id = j.junction_id"""
)
def observed_with_zeros(spark, sf):
    counts = I.counts(spark, sf)
    data = C.Dataset(
        I.cells(spark, sf),
        I.junctions(spark, sf),
        {C.JUNCTION_LAYER: counts.drop("atse_id"), C.CLUSTER_LAYER: C.atse_totals(counts)},
    )
    return C.observed_entries(data, include_zeros=True).select("cell_id", "junction_id", "y", "n")


@query(Q.with_ctes(*BASE) + "SELECT cell_id, junction_id, round(y / n, 6) AS psi FROM obs WHERE n <> 0")
def observed_psi(spark, sf):
    return C.observed_psi(_obs(spark, sf)).select("cell_id", "junction_id", "psi")


@query(Q.with_ctes(*BASE, Q.CENTERED) + "SELECT cell_id, junction_id, round(w, 6) AS w, round(w_psi, 6) AS w_psi FROM centered")
def precision_weights(spark, sf):
    return (
        C.observed_psi(_obs(spark, sf))
        .withColumn("w", C.precision_weight())
        .select("cell_id", "junction_id", "w", (F.col("w") * F.col("psi")).alias("w_psi"))
    )


@query(Q.with_ctes(*BASE, Q.CENTERED) + "SELECT junction_id, round(junction_mean, 6) AS junction_mean FROM means")
def junction_means(spark, sf):
    return C.junction_means(_obs(spark, sf))


@query(
    Q.with_ctes(*BASE, Q.CENTERED)
    + "SELECT cell_id, junction_id, round(psi, 6) AS psi, round(junction_mean, 6) AS junction_mean, round(centered, 6) AS centered FROM centered"
)
def centered_psi(spark, sf):
    return C.centered_psi(_obs(spark, sf)).select("cell_id", "junction_id", "psi", "junction_mean", "centered")


@query(
    Q.with_ctes(*BASE, Q.CENTERED, Q.CELLS)
    + """, per_type AS (
      SELECT cell_type, junction_id, avg(centered) AS mean_centered, CAST(count(*) AS BIGINT) AS n_entries
      FROM centered JOIN cells USING (cell_id) GROUP BY cell_type, junction_id)
    SELECT cell_type, junction_id, round(mean_centered, 6) AS mean_centered, n_entries, CAST(rk AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY mean_centered DESC, junction_id) AS rk FROM per_type) t
    WHERE rk <= 5"""
)
def type_markers(spark, sf):
    """Flagship: the junctions whose usage in a cell type is furthest above their overall mean."""
    centered = C.centered_psi(_obs(spark, sf)).select("cell_id", "junction_id", "centered")
    labelled = C.attach_labels(centered, I.cells(spark, sf), ["cell_type"])
    means = labelled.groupBy("cell_type", "junction_id").agg(
        F.avg("centered").alias("mean_centered"), F.count(F.lit(1)).alias("n_entries")
    )
    return S.top_per_group(means, ["cell_type"], [F.desc("mean_centered"), F.asc("junction_id")], 5)


_MASK = """, n_cells AS (SELECT count(*) AS n FROM cells),
    mask AS (
      SELECT j.junction_id, coalesce(t.total, 0) / (SELECT n FROM n_cells) AS mean_count
      FROM junctions j LEFT JOIN (SELECT junction_id, sum(y) AS total FROM counts GROUP BY junction_id) t USING (junction_id)),
    kept AS (SELECT *, mean_count > CAST(0.22 AS DOUBLE) AS keep FROM mask)"""


@query(
    Q.with_ctes(*BASE, Q.CELLS, Q.JUNCTIONS)
    + _MASK
    + " SELECT junction_id, round(mean_count, 6) AS mean_count, keep FROM kept"
)
def junction_mask(spark, sf):
    return C.keep_mask(I.counts(spark, sf), I.cells(spark, sf), I.junctions(spark, sf), 0.22)


@query(
    Q.with_ctes(*BASE, Q.CELLS, Q.JUNCTIONS)
    + _MASK
    + """ SELECT o.cell_id, o.junction_id, o.y, o.n FROM obs o JOIN kept k USING (junction_id) WHERE k.keep"""
)
def filter_junctions(spark, sf):
    obs = _obs(spark, sf)
    counts, totals, _ = C.filter_junctions(
        obs.select("cell_id", "junction_id", "y"),
        obs.select("cell_id", "junction_id", "n"),
        I.cells(spark, sf),
        I.junctions(spark, sf),
        0.22,
    )
    return counts.join(totals, ["cell_id", "junction_id"]).select("cell_id", "junction_id", "y", "n")


@query(
    Q.with_ctes(*BASE)
    + """, top AS (SELECT junction_id FROM counts GROUP BY junction_id ORDER BY sum(y) DESC, junction_id LIMIT 50)
    SELECT cell_id, junction_id, y FROM counts WHERE junction_id IN (SELECT junction_id FROM top)"""
)
def top_junctions(spark, sf):
    counts = I.counts(spark, sf)
    return C.restrict(counts, C.top_junctions(counts, 50)).select("cell_id", "junction_id", "y")


@query(
    Q.with_ctes(Q.CELLS)
    + """SELECT cell_id, cell_type, tissue FROM cells
         ORDER BY md5(concat_ws('|', CAST(cell_id AS VARCHAR), '42')), cell_id LIMIT 200"""
)
def sample_cells(spark, sf):
    return C.sample_cells(I.cells(spark, sf), 200, 42).select("cell_id", "cell_type", "tissue")


@query(
    Q.with_ctes(*BASE, Q.CELLS, Q.JUNCTIONS)
    + """SELECT nnz, n_cells, n_junctions, round(nnz / CAST(n_cells * n_junctions AS DOUBLE), 6) AS density,
                round(1 - nnz / CAST(n_cells * n_junctions AS DOUBLE), 6) AS sparsity
         FROM (SELECT (SELECT count(*) FROM counts) AS nnz, (SELECT count(*) FROM cells) AS n_cells,
                      (SELECT count(*) FROM junctions) AS n_junctions) t"""
)
def density(spark, sf):
    return C.density(I.counts(spark, sf), I.cells(spark, sf), I.junctions(spark, sf))


@query(
    Q.with_ctes(*BASE, Q.CELLS)
    + "SELECT cell_id, coalesce(sum(y), CAST(0 AS DOUBLE)) AS total FROM cells LEFT JOIN counts USING (cell_id) GROUP BY cell_id"
)
def sum_by_cell(spark, sf):
    return C.sum_by(I.counts(spark, sf), "cell_id", keys=I.cells(spark, sf))


@query(
    Q.with_ctes(*BASE, Q.JUNCTIONS)
    + """SELECT j.junction_id, coalesce(t.total, CAST(0 AS DOUBLE)) AS total FROM junctions j
         LEFT JOIN (SELECT junction_id, sum(y) AS total FROM counts GROUP BY junction_id) t USING (junction_id)"""
)
def sum_by_junction(spark, sf):
    return C.sum_by(I.counts(spark, sf), "junction_id", keys=I.junctions(spark, sf))


@query(
    Q.with_ctes(*BASE)
    + """, g AS (SELECT cell_id, atse_id, sum(CASE WHEN y > 0 AND NOT n > 0 THEN 1 ELSE 0 END) AS a,
                 sum(CASE WHEN y < 0 OR y > n THEN 1 ELSE 0 END) AS b, sum(y) AS s, min(n) AS lo, max(n) AS hi
                 FROM obs GROUP BY cell_id, atse_id)
    SELECT CAST(sum(a) AS BIGINT) AS y_without_n, CAST(0 AS BIGINT) AS not_finite, CAST(sum(b) AS BIGINT) AS out_of_range,
           CAST(sum(CASE WHEN lo <> hi THEN 1 ELSE 0 END) AS BIGINT) AS n_differs,
           CAST(sum(CASE WHEN s <> hi THEN 1 ELSE 0 END) AS BIGINT) AS sum_mismatch FROM g"""
)
def invariant_check(spark, sf):
    return C.violations(_obs(spark, sf))


@query(
    Q.with_ctes(*BASE, Q.CELLS)
    + """SELECT cell_id, junction_id, y, n, cell_type FROM obs JOIN cells USING (cell_id)
         WHERE cell_type IN ('BUILDING', 'MACHINERY') AND atse_id = 'Brand#2'"""
)
def cluster_rows(spark, sf):
    """Entries of one ATSE in two cell types."""
    obs = C.where_in(_obs(spark, sf), "atse_id", ["Brand#2"])
    cells = C.where_in(I.cells(spark, sf), "cell_type", ["BUILDING", "MACHINERY"])
    return C.attach_labels(obs, cells, ["cell_type"]).select("cell_id", "junction_id", "y", "n", "cell_type")


@query(
    Q.with_ctes(*BASE, Q.JUNCTIONS)
    + """SELECT junction_id, total, coalesce(gene_name, junction_id) AS label
         FROM (SELECT junction_id, sum(y) AS total FROM counts GROUP BY junction_id) t
         LEFT JOIN junctions USING (junction_id)"""
)
def annotate_junctions(spark, sf):
    totals = C.sum_by(I.counts(spark, sf), "junction_id")
    return C.annotate(totals, I.junctions(spark, sf)).select("junction_id", "total", "label")


@query(
    Q.with_ctes(*BASE, Q.JUNCTIONS)
    + """SELECT DISTINCT junction_id, gene_id AS gene_id FROM counts JOIN junctions USING (junction_id)"""
)
def junction_lookup(spark, sf):
    return C.lookup(I.counts(spark, sf), I.junctions(spark, sf), "gene_id")


@query(
    """SELECT DISTINCT label, replace(CASE WHEN position('Myeloid_' IN label) > 0
              THEN substr(label, length(label) - position(reverse('Myeloid_') IN reverse(label)) + 2) ELSE label END,
              'oligodendrocyte_precursor_cell', 'oligodendrocyte_' || chr(10) || 'precursor_cell') AS shown
       FROM (SELECT CASE WHEN c_nationkey < 12 THEN concat('Myeloid_', c_mktsegment)
                         WHEN c_nationkey = 12 THEN 'oligodendrocyte_precursor_cell' ELSE c_mktsegment END AS label
             FROM customer) t"""
)
def clean_labels(spark, sf):
    tissue = F.col("tissue").cast("int")
    raw = (
        F.when(tissue < 12, F.concat(F.lit("Myeloid_"), "cell_type"))
        .when(tissue == 12, F.lit("oligodendrocyte_precursor_cell"))
        .otherwise(F.col("cell_type"))
    )
    labels = I.cells(spark, sf).select(raw.alias("label")).distinct()
    return labels.select("label", C.clean_label("label").alias("shown"))


# ---- likelihood ---------------------------------------------------------------------------

PRED = (*BASE, Q.PSI, Q.PHI, Q.PREDICTED)


def _predicted(spark, sf):
    return likelihood.predicted_usage(_obs(spark, sf), I.phi(spark, sf), I.psi(spark, sf), I.K)


@query(Q.with_ctes(*PRED) + "SELECT cell_id, junction_id, y, n, round(p, 6) AS p FROM predicted")
def predicted_usage(spark, sf):
    return _predicted(spark, sf).select("cell_id", "junction_id", "y", "n", "p")


_BB = """lgamma(n + 1) - lgamma(y + 1) - lgamma(n - y + 1) + lgamma(y + q * c) + lgamma(n - y + (1 - q) * c)
  + lgamma(c) - lgamma(n + c) - lgamma(q * c) - lgamma((1 - q) * c)"""


@query(
    Q.with_ctes(*PRED)
    + f"""SELECT c AS concentration, round(sum({_BB}), 4) AS loglik
          FROM predicted, (SELECT CAST(unnest([1, 3, 10, 30]) AS DOUBLE) AS c) g GROUP BY c"""
)
def betabinom_loglik(spark, sf):
    out = likelihood.betabinomial_loglik(_predicted(spark, sf), [1.0, 3.0, 10.0, 30.0])
    return out.withColumn("loglik", F.round("loglik", 4))


_BIN = "y * ln(q) + (n - y) * ln(1 - q)"


@query(Q.with_ctes(*PRED) + f"SELECT round(sum({_BIN}), 4) AS loglik FROM predicted")
def binom_loglik(spark, sf):
    return likelihood.binomial_loglik(_predicted(spark, sf)).select(F.round("loglik", 4).alias("loglik"))


@query(
    Q.with_ctes(*PRED)
    + f"SELECT round(sum(lgamma(n + 1) - lgamma(y + 1) - lgamma(n - y + 1) + {_BIN}), 4) AS loglik FROM predicted"
)
def binom_loglik_full(spark, sf):
    out = likelihood.binomial_loglik(_predicted(spark, sf), include_constant=True)
    return out.select(F.round("loglik", 4).alias("loglik"))


# ---- effects and false discovery rates ----------------------------------------------------

FACTOR = (Q.PURCHASES, Q.PSI_SAMPLES, Q.FACTOR_EFFECTS)
_EFFECT = """round(effect_size, 6) AS effect_size, round(effect_size_var, 6) AS effect_size_var,
  round(prob_greater, 6) AS prob_greater, num_greater"""


@query(
    Q.with_ctes(*FACTOR)
    + f"""SELECT junction_id, factor_idx, {_EFFECT}, round(1 - prob_greater, 6) AS prob_lessoreq,
          round(psi_factor_mean, 6) AS psi_factor_mean, round(psi_nonfactor_mean, 6) AS psi_nonfactor_mean FROM effects"""
)
def factor_effects(spark, sf):
    return D.factor_effects(I.psi_samples(spark, sf))


@query(
    Q.with_ctes(*FACTOR, Q.fdr("factor_idx", "0.1", "0.2"))
    + f"""SELECT junction_id, factor_idx, {_EFFECT}, round(abs_effect_size, 6) AS abs_effect_size,
          round(fdr_curve, 6) AS fdr_curve, significant, n_significant, CAST(0.1 AS DOUBLE) AS delta FROM scored"""
)
def factor_fdr(spark, sf):
    scored = D.analyze_all_factors(I.psi_samples(spark, sf), min_effect_size=0.1, fdr_threshold=0.2)
    return scored.drop("prob_lessoreq", "psi_factor_mean", "psi_nonfactor_mean")


@query(
    Q.with_ctes(*BASE, Q.PSI_SAMPLES, Q.FACTOR_EFFECTS)
    + f""", top AS (SELECT junction_id FROM counts GROUP BY junction_id ORDER BY sum(y) DESC, junction_id LIMIT 20)
    SELECT junction_id, factor_idx, {_EFFECT} FROM effects WHERE junction_id IN (SELECT junction_id FROM top)"""
)
def factor_effects_listed(spark, sf):
    """Effects for a list of junctions."""
    listed = C.top_junctions(I.counts(spark, sf), 20)
    effects = D.factor_effects(I.psi_samples(spark, sf), junctions=listed)
    return effects.select("junction_id", "factor_idx", "effect_size", "effect_size_var", "prob_greater", "num_greater")


GROUP = (Q.PURCHASES, Q.CELLS, Q.PSI_SAMPLES, Q.PHI_SAMPLES)
PAIR = ("cell_type", "BUILDING", "MACHINERY")
REST = ("partial_label", "MACHINERY", None)
DELTA = 0.005


def _group(spark, sf, contrast):
    return D.group_effects(
        I.psi_samples(spark, sf), I.phi_samples(spark, sf), I.cells(spark, sf), *contrast, min_effect_size=DELTA
    )


@query(
    Q.with_ctes(*GROUP, Q.group_activity(Q.PAIR_SIDE), Q.group_effects("0.005"))
    + f"""SELECT junction_id, 'cell_type' AS groupby_column, 'BUILDING' AS group_1, 'MACHINERY' AS group_2, {_EFFECT},
          round(1 - prob_greater, 6) AS prob_lessoreq FROM effects"""
)
def group_effects_pair(spark, sf):
    return _group(spark, sf, PAIR).drop("mean_psi_1", "mean_psi_2")


@query(
    Q.with_ctes(*GROUP, Q.group_activity(Q.REST_SIDE), Q.group_effects("0.005"))
    + f"""SELECT junction_id, 'partial_label' AS groupby_column, 'MACHINERY' AS group_1, 'All Others' AS group_2, {_EFFECT},
          round(1 - prob_greater, 6) AS prob_lessoreq FROM effects"""
)
def group_effects_rest(spark, sf):
    return _group(spark, sf, REST).drop("mean_psi_1", "mean_psi_2")


@query(
    Q.with_ctes(*GROUP, Q.group_activity(Q.PAIR_SIDE), Q.group_effects("0.005"))
    + """SELECT junction_id, CAST(row_number() OVER (PARTITION BY junction_id ORDER BY sample) - 1 AS INTEGER) AS position,
         round(m1, 6) AS mean_psi_1, round(m2, 6) AS mean_psi_2 FROM per_sample"""
)
def group_effect_vectors(spark, sf):
    """The per-sample means of both sides, by position in their arrays."""
    effects = _group(spark, sf, PAIR)
    zipped = F.arrays_zip("mean_psi_1", "mean_psi_2")
    return effects.select("junction_id", F.posexplode(zipped).alias("position", "m")).select(
        "junction_id", "position", "m.mean_psi_1", "m.mean_psi_2"
    )


@query(
    Q.with_ctes(*GROUP, Q.group_activity(Q.PAIR_SIDE), Q.group_effects("0.005"), Q.fdr("", "0.005", "0.2"))
    + f"""SELECT junction_id, 'BUILDING' AS group_1, 'MACHINERY' AS group_2, {_EFFECT},
          round(abs_effect_size, 6) AS abs_effect_size, round(fdr_curve, 6) AS fdr_curve, significant, n_significant,
          CAST(0.005 AS DOUBLE) AS delta FROM scored"""
)
def group_fdr(spark, sf):
    scored = D.group_fdr(_group(spark, sf, PAIR), 0.2, DELTA)
    return scored.drop("groupby_column", "mean_psi_1", "mean_psi_2", "prob_lessoreq")


@query(
    Q.with_ctes(*GROUP, Q.group_activity(Q.REST_SIDE))
    + """SELECT factor_idx, 'partial_label' AS groupby_column, 'MACHINERY' AS group_1, 'All Others' AS group_2,
         round(avg(mean_1 - mean_2), 6) AS effect_size, round(var_samp(mean_1 - mean_2), 6) AS effect_size_var,
         round(avg(CASE WHEN abs(mean_1 - mean_2) > CAST(0.005 AS DOUBLE) + CAST(1e-12 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS prob_greater,
         sum(CASE WHEN abs(mean_1 - mean_2) > CAST(0.005 AS DOUBLE) + CAST(1e-12 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS num_greater,
         round(avg(mean_1), 6) AS mean_activity_1, round(avg(mean_2), 6) AS mean_activity_2
         FROM activity GROUP BY factor_idx"""
)
def activity_contrast(spark, sf):
    return D.activity_contrast(I.phi_samples(spark, sf), I.cells(spark, sf), *REST, min_effect_size=DELTA).drop(
        "prob_lessoreq"
    )


# ---- posterior summaries, pruning, runs ---------------------------------------------------


@query(
    Q.with_ctes(Q.PURCHASES, Q.PSI_SAMPLES)
    + """SELECT factor_idx, junction_id, round(avg(psi), 6) AS mean, round(stddev_samp(psi), 6) AS std
         FROM psi_samples GROUP BY factor_idx, junction_id"""
)
def posterior_summary(spark, sf):
    return posterior.posterior_summary(I.psi_samples(spark, sf), "psi", ["factor_idx", "junction_id"])


PRUNE = (Q.PURCHASES, Q.PI, Q.PHI, Q.PSI, Q.PSI_SAMPLES) + (
    """
kept AS (
  SELECT factor_idx AS old_idx, CAST(row_number() OVER (ORDER BY factor_idx) - 1 AS INTEGER) AS new_idx, pi
  FROM pi WHERE pi > CAST(0.2 AS DOUBLE))""",
)


def _pruned(spark, sf):
    return posterior.prune_factors(
        I.pi(spark, sf), I.phi(spark, sf), I.psi(spark, sf), I.psi_samples(spark, sf), threshold=0.2
    )


@query(Q.with_ctes(*PRUNE) + "SELECT new_idx AS factor_idx, round(pi / (SELECT sum(pi) FROM kept), 6) AS pi FROM kept")
def prune_pi(spark, sf):
    return _pruned(spark, sf)["pi"]


@query(
    Q.with_ctes(*PRUNE)
    + """SELECT cell_id, new_idx AS factor_idx, round(phi / sum(phi) OVER (PARTITION BY cell_id), 6) AS phi
         FROM phi JOIN kept ON factor_idx = old_idx"""
)
def prune_factors(spark, sf):
    return _pruned(spark, sf)["phi"]


@query(
    Q.with_ctes(*PRUNE)
    + """SELECT new_idx AS factor_idx, junction_id, round(avg(psi), 6) AS mean, round(stddev_samp(psi), 6) AS std
         FROM psi_samples JOIN kept ON factor_idx = old_idx GROUP BY new_idx, junction_id"""
)
def prune_stats(spark, sf):
    return _pruned(spark, sf)["psi_stats"]


@query(
    Q.with_ctes(Q.PURCHASES, Q.PHI)
    + """, dense AS (
      SELECT cell_id, factor_idx, CASE WHEN phi > CAST(0.3 AS DOUBLE) THEN phi ELSE CAST(0 AS DOUBLE) END AS phi FROM phi)
    SELECT cell_id, factor_idx, round((phi + CAST(1e-6 AS DOUBLE)) / sum(phi + CAST(1e-6 AS DOUBLE)) OVER (PARTITION BY cell_id), 6) AS phi FROM dense"""
)
def simplex_floor(spark, sf):
    low_cut = I.phi(spark, sf).withColumn("phi", F.when(F.col("phi") > 0.3, F.col("phi")).otherwise(0.0))
    return posterior.simplex_floor(low_cut)


@query(
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS run_id, count(*) AS n_epochs, round(avg(o_totalprice), 6) AS final_loss
       FROM orders GROUP BY 1 ORDER BY avg(o_totalprice), 1 LIMIT 1"""
)
def best_run(spark, sf):
    return posterior.best_run(I.runs(spark, sf))


@query(
    Q.with_ctes(Q.PURCHASES, Q.PHI, Q.PI)
    + """, params AS (
      SELECT 'phi' AS variable, cell_id AS i0, CAST(factor_idx AS BIGINT) AS i1 FROM phi
      UNION ALL SELECT 'pi', CAST(factor_idx AS BIGINT), NULL FROM pi)
    SELECT variable, concat_ws('x', CAST(max(i0) + 1 AS VARCHAR), CAST(max(i1) + 1 AS VARCHAR)) AS shape, count(*) AS n_elements
    FROM params GROUP BY variable"""
)
def variable_sizes(spark, sf):
    phi = I.phi(spark, sf).select(
        F.lit("phi").alias("variable"), F.array("cell_id", F.col("factor_idx").cast("long")).alias("idx")
    )
    pi = I.pi(spark, sf).select(F.lit("pi").alias("variable"), F.array(F.col("factor_idx").cast("long")).alias("idx"))
    sizes = posterior.variable_sizes(phi.unionByName(pi))
    return sizes.select("variable", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"), "n_elements")


# ---- markers and summaries ----------------------------------------------------------------

DEVIATION = (
    Q.PURCHASES,
    Q.PSI,
    "\ndeviations AS (SELECT *, psi - avg(psi) OVER (PARTITION BY junction_id) AS deviation FROM psi)",
)


@query(Q.with_ctes(*DEVIATION) + "SELECT factor_idx, junction_id, round(psi, 6) AS psi, round(deviation, 6) AS deviation FROM deviations")
def psi_deviation(spark, sf):
    return S.psi_deviation(I.psi(spark, sf))


@query(
    Q.with_ctes(*DEVIATION, Q.JUNCTIONS)
    + """SELECT factor_idx, junction_id, round(deviation, 6) AS deviation, CAST(rk AS INTEGER) AS rank, coalesce(gene_name, junction_id) AS label
         FROM (SELECT *, row_number() OVER (PARTITION BY factor_idx ORDER BY deviation DESC, junction_id) AS rk FROM deviations) t
         LEFT JOIN junctions USING (junction_id) WHERE rk <= 5"""
)
def program_markers(spark, sf):
    top = S.program_markers(I.psi(spark, sf), 5)
    return C.annotate(top, I.junctions(spark, sf)).select("factor_idx", "junction_id", "deviation", "rank", "label")


@query(
    Q.with_ctes(Q.PURCHASES, Q.PSI)
    + """SELECT factor_idx, junction_id, round(psi, 6) AS psi, round(abs(psi - CAST(0.5 AS DOUBLE)), 6) AS extremity FROM psi
         WHERE factor_idx = 2 ORDER BY abs(psi - CAST(0.5 AS DOUBLE)) DESC, junction_id LIMIT 20"""
)
def extreme_markers(spark, sf):
    return S.extreme_markers(I.psi(spark, sf), 2, 20)


@query(
    Q.with_ctes(Q.PURCHASES, Q.PSI)
    + """, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY junction_id ORDER BY psi DESC, factor_idx) AS rk,
             lead(psi) OVER (PARTITION BY junction_id ORDER BY psi DESC, factor_idx) AS psi_second FROM psi)
    SELECT junction_id, factor_idx, round(psi, 6) AS psi_top, round(psi_second, 6) AS psi_second FROM ranked
    WHERE rk = 1 AND psi >= CAST(0.19 AS DOUBLE) AND coalesce(psi_second, 0) <= CAST(0.185 AS DOUBLE)"""
)
def exclusive_markers(spark, sf):
    return S.exclusive_markers(I.psi(spark, sf), high=0.19, low=0.185)


@query(
    Q.with_ctes(Q.PURCHASES, Q.PHI, Q.CELLS)
    + """SELECT tissue, factor_idx, round(mean_phi, 6) AS mean_phi, CAST(rk AS INTEGER) AS rank FROM (
           SELECT *, row_number() OVER (PARTITION BY factor_idx ORDER BY mean_phi DESC, tissue) AS rk FROM (
             SELECT tissue, factor_idx, avg(phi) AS mean_phi FROM phi JOIN cells USING (cell_id) GROUP BY tissue, factor_idx) a) b
         WHERE rk <= 15"""
)
def activity_by_type(spark, sf):
    return S.activity_by_type(I.phi(spark, sf), I.cells(spark, sf), "tissue", 15)


@query(
    Q.with_ctes(Q.PURCHASES, Q.PHI)
    + "SELECT factor_idx, round(var_pop(phi), 6) AS variance FROM phi GROUP BY factor_idx ORDER BY var_pop(phi) DESC, factor_idx LIMIT 3"
)
def activity_variance(spark, sf):
    return S.activity_variance(I.phi(spark, sf), 3)


def _hist_sql(ctes: tuple, source: str, group: str, bins: int) -> str:
    keys = f"{group}, " if group else ""
    using = f"USING ({group})" if group else "ON true"
    match = f"g.{group} = c.{group} AND " if group else ""
    grouped = f"GROUP BY {group}" if group else ""
    shown = f"g.{group}, " if group else ""
    return (
        Q.with_ctes(*ctes)
        + f""", src AS ({source}), bounds AS (SELECT {keys}min(v) AS lo, max(v) AS hi FROM src {grouped}),
    placed AS (SELECT {keys}least({bins}, CAST(floor((v - lo) * {bins} / (hi - lo)) AS INTEGER) + 1) AS bin, count(*) AS n
               FROM src JOIN bounds {using} GROUP BY ALL),
    grid AS (SELECT *, CAST(unnest(range(1, {bins} + 1)) AS INTEGER) AS bin FROM bounds)
    SELECT {shown}g.bin, round(lo + (hi - lo) / {bins} * (g.bin - 1), 6) AS left_edge, coalesce(c.n, 0) AS n
    FROM grid g LEFT JOIN placed c ON {match}g.bin = c.bin"""
    )


@query(_hist_sql((Q.PURCHASES, Q.PHI), "SELECT factor_idx, phi AS v FROM phi", "factor_idx", 50))
def activity_hist(spark, sf):
    return S.activity_histogram(I.phi(spark, sf), 50)


@query(
    _hist_sql(
        (*BASE, Q.CELLS),
        "SELECT log10(sum(y) / (SELECT count(*) FROM cells)) AS v FROM counts GROUP BY junction_id",
        "",
        100,
    )
)
def mean_count_hist(spark, sf):
    return S.mean_count_histogram(C.mean_counts(I.counts(spark, sf), I.cells(spark, sf)), 100)


@query(Q.with_ctes(*BASE, Q.CELLS) + "SELECT cell_type, count(*) AS n FROM obs JOIN cells USING (cell_id) GROUP BY cell_type")
def type_counts(spark, sf):
    return S.type_counts(C.attach_labels(I.counts(spark, sf), I.cells(spark, sf), ["cell_type"]))


@query(
    Q.with_ctes(*BASE, Q.CELLS)
    + f"""SELECT cell_type, junction_id, count(*) AS n, round(avg(y / n), 6) AS mean, {Q.quantiles("y / n")}
          FROM obs JOIN cells USING (cell_id) WHERE n <> 0 GROUP BY cell_type, junction_id"""
)
def psi_quartiles(spark, sf):
    return S.psi_quartiles(_obs(spark, sf), I.cells(spark, sf))


@query(
    Q.with_ctes(*BASE, Q.CELLS)
    + f"""SELECT cell_type, count(*) AS n, round(avg(y / n), 6) AS mean, {Q.quantiles("y / n")}
          FROM obs JOIN cells USING (cell_id) WHERE n <> 0 GROUP BY cell_type"""
)
def psi_quartiles_by_type(spark, sf):
    return S.psi_quartiles(_obs(spark, sf), I.cells(spark, sf), per_junction=False)


@query(
    Q.with_ctes(Q.PURCHASES, Q.PSI_SAMPLES)
    + f"""SELECT junction_id, "group", count(*) AS n, round(avg(psi), 6) AS mean, {Q.quantiles("psi")}
          FROM (SELECT *, CASE WHEN factor_idx = 0 THEN 'Reference Factor' ELSE 'Other Factors' END AS "group" FROM psi_samples) t
          GROUP BY junction_id, "group" """
)
def ref_vs_others(spark, sf):
    return S.reference_vs_others(I.psi_samples(spark, sf), 0)


_WIDE = ", ".join(f"max(CASE WHEN factor_idx = {i} THEN round(phi, 6) END) AS SP_{i + 1}" for i in range(I.K))


@query(
    Q.with_ctes(Q.PURCHASES, Q.PHI, Q.CELLS)
    + f"SELECT cell_id, cell_type, tissue, {_WIDE} FROM cells LEFT JOIN phi USING (cell_id) GROUP BY cell_id, cell_type, tissue"
)
def activity_wide(spark, sf):
    return S.export_activities(I.phi(spark, sf), I.cells(spark, sf), I.K).drop("partial_label")


@query(
    Q.with_ctes(Q.PURCHASES, Q.PHI, Q.CELLS)
    + f"""SELECT cell_type, concat('SP_', CAST(factor_idx + 1 AS VARCHAR)) AS program, count(*) AS n, round(avg(phi), 6) AS mean,
          {Q.quantiles("phi")} FROM phi JOIN cells USING (cell_id) GROUP BY cell_type, factor_idx"""
)
def activity_box(spark, sf):
    return S.activity_box(S.export_activities(I.phi(spark, sf), I.cells(spark, sf), I.K))


SCORES = "\nscores AS (SELECT junction_id, log2(max(psi) / min(psi)) * 4 - CAST(0.5 AS DOUBLE) AS score FROM psi GROUP BY junction_id)"
_PARAMS = ", ".join(
    f"""round(max(CASE WHEN factor_idx = {i} THEN mean END), 6) AS psi_{i},
        round(max(CASE WHEN factor_idx = {i} THEN ln(mean / (1 - mean)) END), 6) AS mu_{i},
        round(max(CASE WHEN factor_idx = {i} THEN std END), 6) AS loc_{i}"""
    for i in range(I.K)
)


@query(
    Q.with_ctes(Q.PURCHASES, Q.PSI, Q.PSI_SAMPLES, SCORES)
    + f""", stats AS (SELECT factor_idx, junction_id, avg(psi) AS mean, stddev_samp(psi) AS std FROM psi_samples GROUP BY factor_idx, junction_id)
    SELECT junction_id, {_PARAMS}, round(max(score), 6) AS score FROM stats JOIN scores USING (junction_id) GROUP BY junction_id"""
)
def score_table(spark, sf):
    stats = posterior.posterior_summary(I.psi_samples(spark, sf), "psi", ["factor_idx", "junction_id"])
    logit = F.log(F.col("mean") / (F.lit(1.0) - F.col("mean")))
    params = stats.select(
        "factor_idx", "junction_id", F.col("mean").alias("psi"), logit.alias("mu"), F.col("std").alias("loc")
    )
    return S.score_table(params, I.scores(spark, sf), I.K)


# ---- agreement between runs, separation, mixture FDR --------------------------------------

# Correlation over all cells with any purchase; an absent row is activity 0.
CORR = (Q.PURCHASES, Q.PHI_SAMPLES) + (
    """
n_cells AS (SELECT CAST(count(DISTINCT cell_id) AS DOUBLE) AS n FROM phi_samples),
moments AS (
  SELECT sample, factor_idx, sum(phi) / (SELECT n FROM n_cells) AS m, sum(phi * phi) / (SELECT n FROM n_cells) AS s
  FROM phi_samples GROUP BY sample, factor_idx),
cross_sums AS (
  SELECT a.sample AS run_a, b.sample AS run_b, a.factor_idx AS factor_a, b.factor_idx AS factor_b,
         sum(a.phi * b.phi) / (SELECT n FROM n_cells) AS xy
  FROM phi_samples a JOIN phi_samples b ON a.cell_id = b.cell_id AND b.sample < a.sample GROUP BY ALL),
correlations AS (
  SELECT run_a, run_b, factor_a, factor_b,
         (xy - ma.m * mb.m) / sqrt((ma.s - ma.m * ma.m) * (mb.s - mb.m * mb.m)) AS corr
  FROM cross_sums JOIN moments ma ON ma.sample = run_a AND ma.factor_idx = factor_a
       JOIN moments mb ON mb.sample = run_b AND mb.factor_idx = factor_b)""",
)


def _greedy_sql(k: int) -> tuple[str, ...]:
    """The greedy matching unrolled: step i takes each pair's best remaining correlation."""
    steps, left = [], "correlations"
    for i in range(k):
        steps.append(
            f"""
pick{i} AS (
  SELECT * FROM {left} QUALIFY row_number() OVER (PARTITION BY run_a, run_b ORDER BY corr DESC, factor_a, factor_b) = 1),
left{i} AS (
  SELECT l.* FROM {left} l JOIN pick{i} p USING (run_a, run_b)
  WHERE l.factor_a <> p.factor_a AND l.factor_b <> p.factor_b)"""
        )
        left = f"left{i}"
    union = " UNION ALL ".join(f"SELECT * FROM pick{i}" for i in range(k))
    steps.append(f"\nmatched AS ({union})")
    steps.append("\nrun_corr AS (SELECT run_a, run_b, avg(corr) AS corr FROM matched GROUP BY run_a, run_b)")
    return tuple(steps)


def _run_phi(spark, sf):
    return I.phi_samples(spark, sf).withColumnRenamed("sample", "run_id")


@query(Q.with_ctes(*CORR) + "SELECT run_a, run_b, factor_a, factor_b, round(corr, 6) AS corr FROM correlations")
def factor_correlations(spark, sf):
    return quality.factor_correlations(_run_phi(spark, sf), I.K)


@query(Q.with_ctes(*CORR, *_greedy_sql(I.K)) + "SELECT run_a, run_b, round(corr, 6) AS corr FROM run_corr")
def run_correlation(spark, sf):
    return quality.run_correlation(_run_phi(spark, sf), I.K)


@query(
    Q.with_ctes(*CORR, *_greedy_sql(I.K))
    + "SELECT round(avg(corr), 6) AS average, round(median(corr), 6) AS median, round(min(corr), 6) AS minimum FROM run_corr"
)
def pairwise_corr_stats(spark, sf):
    return quality.pairwise_stats(quality.run_correlation(_run_phi(spark, sf), I.K))


def _silhouette_sql(distance: str) -> str:
    return f"""
WITH p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sums AS (
  SELECT a.vec_id, a.label, b.label AS towards, sum({distance}) AS total, count(*) AS n
  FROM p a CROSS JOIN p b GROUP BY ALL),
per AS (
  SELECT vec_id, label, max(CASE WHEN towards = label THEN total / nullif(n - 1, 0) END) AS a,
         max(CASE WHEN towards = label THEN n END) AS own, min(CASE WHEN towards <> label THEN total / n END) AS b
  FROM sums GROUP BY vec_id, label)
SELECT round(avg(CASE WHEN own > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette, count(*) AS n_cells FROM per"""


@query(_silhouette_sql("list_distance(a.e, b.e)"))
def silhouette(spark, sf):
    return quality.silhouette_score(quality.silhouette_cells(I.points(spark, sf)))


@query(_silhouette_sql("pow(list_distance(a.e, b.e), 2)"))
def silhouette_squared(spark, sf):
    return quality.silhouette_score(quality.silhouette_squared_cells(I.points(spark, sf), 64))


EM = (Q.PURCHASES, Q.PSI, SCORES) + (
    """
b AS (SELECT junction_id, score, greatest(CAST(1e-10 AS DOUBLE), least(1 - CAST(1e-10 AS DOUBLE), 1 / (1 + exp(-score)))) AS b FROM scores)""",
)


def _responsibility_sql(p: str) -> str:
    odds = f"(b / (1 - b) * ({p}) / (1 - ({p})))"
    return f"greatest(CAST(1e-10 AS DOUBLE), least(1 - CAST(1e-10 AS DOUBLE), {odds} / (1 + {odds})))"


@query(
    Q.with_ctes(*EM)
    + f"""SELECT round(avg(q), 6) AS mean_q, round(sum(q * ln(b) + (1 - q) * ln(1 - b)), 4) AS loglik
          FROM (SELECT b, {_responsibility_sql("CAST(0.4 AS DOUBLE)")} AS q FROM b) t"""
)
def em_fdr_step(spark, sf):
    scored = I.scores(spark, sf).withColumn("b", fdr_em.evidence())
    return fdr_em.em_step(scored, 0.4).select("mean_q", F.round("loglik", 4).alias("loglik"))


def _em_sql(steps: int) -> str:
    """The loop unrolled for ``steps`` iterations; the best and last ones are chosen as the loop does."""
    ctes, prior = [], "CAST(0.5 AS DOUBLE)"
    for i in range(steps):
        q = _responsibility_sql("p")
        ctes.append(
            f"""
it{i} AS (SELECT {i} AS i, p, greatest(CAST(0.1 AS DOUBLE), least(CAST(0.9 AS DOUBLE), (p + avg(q)) / 2)) AS next_p,
                 sum(q * ln(b) + (1 - q) * ln(1 - b)) AS ll
          FROM (SELECT p, b, {q} AS q FROM b, (SELECT {prior} AS p) pr) t GROUP BY p)"""
        )
        prior = f"(SELECT next_p FROM it{i})"
    union = " UNION ALL ".join(f"SELECT * FROM it{i}" for i in range(steps))
    ctes.append(f"\nits AS ({union})")
    ctes.append("\ngains AS (SELECT *, ll - lag(ll) OVER (ORDER BY i) AS gain FROM its)")
    ctes.append("\nstop AS (SELECT coalesce(min(i), 10000) AS i FROM gains WHERE gain < CAST(1e-4 AS DOUBLE))")
    ctes.append("\nbest AS (SELECT p FROM its WHERE i <= (SELECT i FROM stop) ORDER BY ll DESC, i LIMIT 1)")
    return (
        Q.with_ctes(*EM, *ctes)
        + f"SELECT junction_id, round(score, 6) AS score, round({_responsibility_sql('p')}, 6) AS posterior_prob FROM b, best"
    )


@query(_em_sql(30))
def em_fdr(spark, sf):
    return fdr_em.fit_mixture(I.scores(spark, sf))[0]


# ---- waypoints and starting factors -------------------------------------------------------

N_WAYPOINTS, N_NEAREST = 6, 5


def _waypoint_ctes(n: int, nearest: int) -> tuple[str, ...]:
    """Farthest-first steps and the metacells that take turns, unrolled."""
    ctes = [
        """
pts AS MATERIALIZED (
  SELECT vec_id AS cell_id, CAST(embedding AS DOUBLE[]) AS e, CAST(embedding[1:10] AS DOUBLE[]) AS x FROM embeddings)""",
        """
w0 AS MATERIALIZED (
  SELECT cell_id, x, e, CAST(NULL AS DOUBLE) AS d FROM pts
  ORDER BY md5(concat_ws('|', CAST(cell_id AS VARCHAR), '42')), cell_id LIMIT 1)""",
        "\nn0 AS MATERIALIZED (SELECT p.cell_id, p.x, p.e, list_distance(p.x, w.x) AS near FROM pts p, w0 w)",
    ]
    for i in range(1, n):
        ctes.append(
            f"\nw{i} AS MATERIALIZED (SELECT cell_id, x, e, near AS d FROM n{i - 1} ORDER BY near DESC, cell_id LIMIT 1)"
        )
        ctes.append(
            f"""
n{i} AS MATERIALIZED (
  SELECT p.cell_id, p.x, p.e, least(p.near, list_distance(p.x, w.x)) AS near FROM n{i - 1} p, w{i} w)"""
        )
    union = " UNION ALL ".join(f"SELECT {i} AS waypoint_idx, cell_id, d FROM w{i}" for i in range(n))
    ctes.append(f"\nwaypoints AS ({union})")
    for i in range(n):
        free = " AND ".join(f"p.cell_id NOT IN (SELECT cell_id FROM m{j})" for j in range(i)) or "true"
        ctes.append(
            f"""
m{i} AS MATERIALIZED (
  SELECT p.cell_id, row_number() OVER (ORDER BY list_distance(p.e, w.e), p.cell_id) - 1 AS rank
  FROM pts p, w{i} w WHERE {free} ORDER BY rank LIMIT {nearest})"""
        )
    union = " UNION ALL ".join(f"SELECT {i} AS metacell_idx, rank, cell_id FROM m{i}" for i in range(n))
    ctes.append(f"\nmetacells AS ({union})")
    return tuple(ctes)


WAYPOINTS = _waypoint_ctes(N_WAYPOINTS, N_NEAREST)


def _waypoints(spark, sf, n=N_WAYPOINTS):
    return W.max_min_waypoints(I.points(spark, sf), n)


def _metacells(spark, sf, n=N_WAYPOINTS):
    return W.assign_metacells(I.points(spark, sf), _waypoints(spark, sf, n), N_NEAREST)


@query(
    Q.with_ctes(*WAYPOINTS)
    + f"SELECT CAST({N_WAYPOINTS} AS INTEGER) AS n_waypoints, CAST(waypoint_idx AS INTEGER) AS waypoint_idx, cell_id, round(d, 6) AS min_dist FROM waypoints"
)
def max_min_waypoints(spark, sf):
    return _waypoints(spark, sf)


@query(
    Q.with_ctes(*WAYPOINTS)
    + f"""SELECT CAST({N_WAYPOINTS} AS INTEGER) AS n_waypoints, CAST(metacell_idx AS INTEGER) AS metacell_idx,
          CAST(rank AS INTEGER) AS rank, cell_id FROM metacells"""
)
def metacells(spark, sf):
    return _metacells(spark, sf)


INIT = (
    *BASE,
    Q.JUNCTIONS,
    *WAYPOINTS,
    """
drawn AS (
  SELECT junction_id, metacell_idx,
         arg_min(y / n, md5(concat_ws('|', CAST(cell_id AS VARCHAR), junction_id, '0'))) AS psi
  FROM obs JOIN metacells USING (cell_id) WHERE y > 0 GROUP BY junction_id, metacell_idx),
psi_init AS (
  SELECT g.metacell_idx AS factor_idx, g.junction_id, coalesce(d.psi, CAST(0.01 AS DOUBLE)) AS psi
  FROM (SELECT junction_id, metacell_idx FROM junctions, (SELECT DISTINCT metacell_idx FROM metacells) m) g
  LEFT JOIN drawn d ON d.junction_id = g.junction_id AND d.metacell_idx = g.metacell_idx)""",
)


# Both the waypoints and their metacells for 2 are the first two of those for 6.
@query(
    Q.with_ctes(*INIT)
    + """SELECT CAST(6 AS INTEGER) AS n_waypoints, CAST(factor_idx AS INTEGER) AS factor_idx, junction_id, round(psi, 6) AS psi FROM psi_init
         UNION ALL SELECT 2, CAST(factor_idx AS INTEGER), junction_id, round(psi, 6) FROM psi_init WHERE factor_idx < 2"""
)
def psi_init(spark, sf):
    members = {n: _metacells(spark, sf, n) for n in (N_WAYPOINTS, 2)}
    return W.generate_initializations(_obs(spark, sf), members, I.junctions(spark, sf), I.cells(spark, sf))[0]


@query(
    Q.with_ctes(*INIT, Q.CELLS)
    + """, v AS (SELECT junction_id, max(CASE WHEN factor_idx = 0 THEN psi END) AS p0, max(CASE WHEN factor_idx = 1 THEN psi END) AS p1
                 FROM psi_init GROUP BY junction_id),
    gram AS (SELECT sum(p0 * p0) AS g00, sum(p0 * p1) AS g01, sum(p1 * p1) AS g11 FROM v),
    rhs AS (SELECT c.cell_id, coalesce(sum(y / n * p0), 0) AS b0, coalesce(sum(y / n * p1), 0) AS b1
            FROM cells c LEFT JOIN obs USING (cell_id) LEFT JOIN v USING (junction_id) GROUP BY c.cell_id),
    solved AS (SELECT cell_id, greatest(CAST(0.01 AS DOUBLE), least(CAST(0.99 AS DOUBLE), (g11 * b0 - g01 * b1) / (g00 * g11 - g01 * g01))) AS f0,
                      greatest(CAST(0.01 AS DOUBLE), least(CAST(0.99 AS DOUBLE), (g00 * b1 - g01 * b0) / (g00 * g11 - g01 * g01))) AS f1 FROM rhs, gram)
    SELECT CAST(2 AS INTEGER) AS n_waypoints, cell_id, CAST(0 AS INTEGER) AS factor_idx, round(f0 / (f0 + f1), 6) AS phi FROM solved
    UNION ALL SELECT 2, cell_id, 1, round(f1 / (f0 + f1), 6) FROM solved"""
)
def phi_init(spark, sf):
    return W.initialize_psi_phi(
        _obs(spark, sf), _metacells(spark, sf, 2), I.junctions(spark, sf), I.cells(spark, sf), 2
    )[1]


@query()
def stored_initialisation(spark, sf):
    """Starting factors for six waypoints, stored and looked up by K."""
    found = W.generate_initializations(
        _obs(spark, sf), {N_WAYPOINTS: _metacells(spark, sf)}, I.junctions(spark, sf), I.cells(spark, sf)
    )
    path = scratch_path(spark, "initialisation")
    IO.save_initialisation(*found, path)
    return IO.load_initialisation(spark, path, N_WAYPOINTS)[1].select("cell_id", "factor_idx", "phi")


@query()
def waypoint_start(spark, sf):
    """Starting activities from counts alone: centred usage, components, waypoints, metacells, factors."""
    obs, junctions, cells = _obs(spark, sf), I.junctions(spark, sf), I.cells(spark, sf)
    return lifecycles.waypoint_initialisation(obs, junctions, cells, [3, N_WAYPOINTS], components=5)[1]


@query()
def pca_coordinates(spark, sf):
    """Four principal coordinates of the centred usage of every cell."""
    coords, _ = W.principal_components(C.centered_psi(_obs(spark, sf)), "centered", 4, iterations=None)
    return coords.select("cell_id", *[F.col("coords")[i].alias(f"pc_{i + 1}") for i in range(4)])


# ---- model fit ----------------------------------------------------------------------------


@query(
    Q.with_ctes(*BASE, Q.PSI, Q.PHI)
    + """, f AS (SELECT factor_idx, junction_id, greatest(CAST(1e-6 AS DOUBLE), least(1 - CAST(1e-6 AS DOUBLE), psi)) AS psi FROM psi),
    grid AS (SELECT o.cell_id, o.junction_id, y, n, phi.factor_idx, phi, coalesce(psi, CAST(1e-6 AS DOUBLE)) AS psi
             FROM obs o JOIN phi USING (cell_id) LEFT JOIN f ON f.junction_id = o.junction_id AND f.factor_idx = phi.factor_idx),
    mixed AS (SELECT *, sum(phi * psi) OVER e AS p1, sum(phi * (1 - psi)) OVER e AS p0 FROM grid WINDOW e AS (PARTITION BY cell_id, junction_id)),
    splits AS (SELECT *, y / p1 * phi * psi AS r1, (n - y) / p0 * phi * (1 - psi) AS r0 FROM mixed)
    SELECT 'cell' AS kind, CAST(cell_id AS VARCHAR) AS key, factor_idx, round(sum(r1), 6) AS r1, round(sum(r0), 6) AS r0 FROM splits GROUP BY cell_id, factor_idx
    UNION ALL
    SELECT 'junction', junction_id, factor_idx, round(sum(r1), 6), round(sum(r0), 6) FROM splits GROUP BY junction_id, factor_idx"""
)
def fit_split_sums(spark, sf):
    """One pass of the fit from given factors: expected splits summed by cell and by junction."""
    k = I.K
    config = M.FitConfig(k=k, concentration=float("inf"))
    cells, junctions = M.split_sums(_obs(spark, sf), I.psi(spark, sf), I.phi(spark, sf), config)
    sides = F.posexplode(F.arrays_zip("r1", "r0")).alias("factor_idx", "r")
    by_cell = cells.select(F.lit("cell").alias("kind"), F.col("cell_id").cast("string").alias("key"), sides)
    by_junction = junctions.select(F.lit("junction").alias("kind"), F.col("junction_id").alias("key"), sides)
    present = I.phi(spark, sf).select(F.lit("cell").alias("kind"), F.col("cell_id").cast("string").alias("key"), "factor_idx")
    by_cell = by_cell.join(present, ["kind", "key", "factor_idx"])
    return by_cell.unionByName(by_junction).select("kind", "key", "factor_idx", "r.r1", "r.r0")


def _binomial(**more):
    return M.FitConfig(k=3, concentration=float("inf"), **more)


@query()
def fit_losses(spark, sf):
    """Loss per epoch of two starts of the binomial model."""
    return M.fit(_obs(spark, sf), _binomial(), seeds=[1, 2]).losses


@query()
def fit_psi(spark, sf):
    """Factors of the beta-binomial model with learned concentration."""
    return M.fit(_obs(spark, sf), M.FitConfig(k=3), seeds=[1]).psi


@query()
def fit_phi(spark, sf):
    """Activities of the best of two starts, through the stored result."""
    result = M.fit(_obs(spark, sf), _binomial(), seeds=[1, 2], cells=I.cells(spark, sf))
    stored = IO.load_fit(spark, IO.save_fit(result, scratch_path(spark, "fit"), 3, 2))
    return posterior.of_best_run(stored.phi, stored.runs).select("run_id", "cell_id", "factor_idx", "phi")


@query()
def transfer_phi(spark, sf):
    """Activities for given factors."""
    return M.transfer(_obs(spark, sf), I.psi(spark, sf), M.FitConfig(k=I.K, concentration=10.0)).phi


@query()
def fitted_program_effects(spark, sf):
    """The whole way from counts to significant junctions per program."""
    psi_draws, _, _ = lifecycles.fit_and_sample(_obs(spark, sf), _binomial(), seeds=[1])
    return lifecycles.program_effects(psi_draws, 0.1, 0.2).select("factor_idx", "junction_id", "effect_size", "fdr_curve", "significant")


@query()
def posterior_draws(spark, sf):
    """Mean and spread of drawn activities after a fit that starts from waypoints."""
    obs, members = _obs(spark, sf), _metacells(spark, sf)
    psi, phi = W.initialize_psi_phi(obs, members, I.junctions(spark, sf), I.cells(spark, sf), N_WAYPOINTS)
    config = M.FitConfig(k=N_WAYPOINTS, concentration=float("inf"))
    result = M.fit(obs, config, seeds=[1], psi_init=psi, phi_init=phi)
    draws = M.sample_phi(result.phi, N_WAYPOINTS, 10, seed=1)
    return posterior.posterior_summary(draws, "phi", ["cell_id", "factor_idx"])


_MIX_SQL = "CAST((CAST(xor({z}, {z} >> {by}) AS UHUGEINT) * CAST({times} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT)"


def _uniform_sql(stream: str, counter: int) -> str:
    """The n-th uniform of a stream, step by step: the mixing function modulo 2 to the 64."""
    start = f"CAST((CAST({stream} AS UHUGEINT) + CAST({(counter + 1) * draws.INCREMENT % 2**64} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT)"
    first, second = draws.MIX
    return f"""(SELECT (CAST(xor(z, z >> 31) >> 11 AS DOUBLE) + 0.5) / 9007199254740992 FROM (SELECT {_MIX_SQL.format(z='z', by=27, times=second)} AS z
        FROM (SELECT {_MIX_SQL.format(z='z', by=30, times=first)} AS z FROM (SELECT {start} AS z))))"""


@query(
    Q.with_ctes(Q.CELLS)
    + f""", keyed AS (SELECT cell_id, CAST('0x' || md5('7|check|' || cell_id)[1:16] AS UBIGINT) AS h FROM cells)
    SELECT cell_id, round({_uniform_sql('h', 0)}, 6) AS u0, round({_uniform_sql('h', 1)}, 6) AS u1, round({_uniform_sql('h', 12345)}, 6) AS u2 FROM keyed"""
)
def draw_uniforms(spark, sf):
    """Three uniforms of the stream of every cell, on which all posterior draws rest."""
    keyed = I.cells(spark, sf).select("cell_id", draws.stream_key(7, "check", "cell_id").alias("h"))

    def draw(frames):
        for f in frames:
            stream = f.column("h").to_numpy().view(np.uint64)
            values = [draws.uniforms(stream, np.full(f.num_rows, n)) for n in (0, 1, 12345)]
            yield pa.RecordBatch.from_arrays([f.column("cell_id"), *map(pa.array, values)], ["cell_id", "u0", "u1", "u2"])

    return keyed.mapInArrow(draw, "cell_id long, u0 double, u1 double, u2 double")


@query()
def posterior_draws_all(spark, sf):
    """Mean and spread of the drawn prior parameters of every junction, saved with a fit and read back."""
    obs = _obs(spark, sf)
    path = lifecycles.fit_and_store(obs, scratch_path(spark, "stored"), _binomial(), 20, 1, seeds=[1], junctions=I.junctions(spark, sf))
    found = IO.load_statistics(spark, path, verify=True)
    a, b = (found[name].selectExpr("junction_id", f"mean AS mean_{name}", f"std AS std_{name}") for name in "ab")
    return a.join(b, "junction_id")


@query(
    Q.with_ctes(*BASE)
    + """SELECT junction_id, part, value, count(*) AS times FROM (
           SELECT junction_id, 'y' AS part, y AS value FROM obs UNION ALL SELECT junction_id, 'f', n - y FROM obs
           UNION ALL SELECT junction_id, 'n', n FROM obs) t GROUP BY junction_id, part, value"""
)
def bb_value_counts(spark, sf):
    return betabinom.value_counts(_obs(spark, sf))


@query()
def bb_mle(spark, sf):
    """Beta-binomial intercept of every junction, zeros included."""
    obs = _obs(spark, sf)
    data = C.Dataset(
        I.cells(spark, sf),
        I.junctions(spark, sf),
        {C.JUNCTION_LAYER: obs.select("cell_id", "junction_id", "y"), C.CLUSTER_LAYER: C.atse_totals(obs)},
    )
    return betabinom.fit_alpha_beta(C.observed_entries(data, include_zeros=True))


# ---- sources and sinks --------------------------------------------------------------------


def _gtf_lines(spark, sf):
    """The part table as annotation lines, with a comment line per brand."""
    part = I.table(spark, sf, "part")
    feature = (
        F.when(F.col("p_type") == "ECONOMY", "exon").when(F.col("p_type") == "LARGE", "transcript").otherwise("gene")
    )
    gene = F.when(F.col("p_type") != "PROMO", F.concat(F.lit('gene_id "'), "p_brand", F.lit('"; ')))
    attributes = F.concat(
        F.coalesce(gene, F.lit("")),
        F.lit('tag "'), "p_type", F.lit('"; tag "'), "p_name", F.lit('"; note "'), "p_name", F.lit('";'),
    )
    start = F.col("p_partkey") * 10 + 1
    fields = [
        F.col("p_brand"), F.lit("catalog"), feature, start.cast("string"), (start + F.col("p_size")).cast("string"),
        F.lit("."), F.lit("+"), F.lit("."), attributes,
    ]
    comments = part.select(F.concat(F.lit("#!brand "), "p_brand").alias("value")).distinct()
    return part.select(F.concat_ws("\t", *fields).alias("value")).unionByName(comments)


def _gtf(spark, sf, feature_type, compression):
    path = scratch_path(spark, "gtf")
    _gtf_lines(spark, sf).write.option("compression", compression).text(path)
    rows = gtf.read_gtf(spark, path, feature_type)
    names = {"gene_id": "gene_id", "tag": "tag", "note": "note"}
    return rows.select(
        "seqname", "source", "feature", "start", "end", "score", "strand", "frame",
        *[F.col("attributes")[key].alias(name) for key, name in names.items()],
    )


_GTF_SQL = """
SELECT p_brand AS seqname, 'catalog' AS source, feature, CAST(p_partkey * 10 + 1 AS INTEGER) AS start,
       CAST(p_partkey * 10 + 1 + p_size AS INTEGER) AS "end", '.' AS score, '+' AS strand, '.' AS frame,
       CASE WHEN p_type <> 'PROMO' THEN concat('"', p_brand, '"') END AS gene_id,
       concat('"', p_name, '"') AS tag, concat('"', p_name, '"') AS note
FROM (SELECT *, CASE p_type WHEN 'ECONOMY' THEN 'exon' WHEN 'LARGE' THEN 'transcript' ELSE 'gene' END AS feature FROM part) t
WHERE """


@query(_GTF_SQL + "true")
def gtf_scan(spark, sf):
    return _gtf(spark, sf, "all", "none")


@query(_GTF_SQL + "feature = 'exon'")
def gtf_exons(spark, sf):
    return _gtf(spark, sf, "exon", "gzip")


@query(_GTF_SQL + "p_type <> 'PROMO'")
def gtf_with_gene(spark, sf):
    return _gtf(spark, sf, "gene_id", "gzip")


@query(Q.with_ctes(*BASE) + "SELECT cell_id, junction_id, atse_id, y, n FROM obs")
def dataset_roundtrip(spark, sf):
    """A dataset written, read back with its checks, and aligned."""
    obs = _obs(spark, sf)
    layers = {C.JUNCTION_LAYER: obs.select("cell_id", "junction_id", "y"), C.CLUSTER_LAYER: C.atse_totals(obs)}
    path = scratch_path(spark, "dataset")
    IO.save_dataset(C.Dataset(I.cells(spark, sf), I.junctions(spark, sf), layers), path)
    return IO.load_observed(spark, path)


@query(ORACLES["posterior_summary"])
def csv_results(spark, sf):
    """A result table through its CSV file."""
    stats = posterior.posterior_summary(I.psi_samples(spark, sf), "psi", ["factor_idx", "junction_id"])
    path = IO.save_results(stats, scratch_path(spark, "csv"))
    return spark.read.schema(stats.schema).option("header", True).csv(path)


@query(
    Q.with_ctes(Q.PURCHASES, Q.PSI)
    + "SELECT junction_id, "
    + ", ".join(f"round(max(CASE WHEN factor_idx = {i} THEN psi END), 6) AS psi_{i}" for i in range(I.K))
    + " FROM psi GROUP BY junction_id"
)
def psi_wide(spark, sf):
    return IO.psi_wide(I.psi(spark, sf), I.K)
