"""Marker rankings, activity summaries and the tables behind the usual plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countloom.functions.ranking import QUARTILES, exact_quantiles, top_per_group
from countloom.operators.counts import observed_psi
from countloom.storage import materialise


def psi_deviation(psi: DataFrame) -> DataFrame:
    """psi minus the junction's mean over factors (a junction has one row per factor)."""
    return psi.withColumn("deviation", F.col("psi") - F.avg("psi").over(Window.partitionBy("junction_id")))


def program_markers(psi: DataFrame, n: int = 5) -> DataFrame:
    """The n junctions of each factor with the largest deviation."""
    return top_per_group(psi_deviation(psi), ["factor_idx"], [F.desc("deviation"), F.asc("junction_id")], n)


def extreme_markers(psi: DataFrame, factor_idx: int, n: int = 20) -> DataFrame:
    """The n junctions of one factor whose psi is furthest from 1/2."""
    return (
        psi.filter(F.col("factor_idx") == factor_idx)
        .withColumn("extremity", F.abs(F.col("psi") - 0.5))
        .orderBy(F.desc("extremity"), F.asc("junction_id"))
        .limit(n)
    )


def exclusive_markers(psi: DataFrame, high: float = 0.9, low: float = 0.1) -> DataFrame:
    """Junctions with psi >= high in one factor and <= low in all others."""
    by_value = F.array_sort(F.collect_list(F.struct((-F.col("psi")).alias("neg"), "factor_idx")))
    ranked = psi.groupBy("junction_id").agg(by_value.alias("_f"))
    return ranked.select(
        "junction_id",
        F.col("_f")[0]["factor_idx"].alias("factor_idx"),
        (-F.col("_f")[0]["neg"]).alias("psi_top"),
        F.when(F.size("_f") > 1, -F.get("_f", F.lit(1))["neg"]).alias("psi_second"),
    ).filter((F.col("psi_top") >= high) & (F.coalesce("psi_second", F.lit(0.0)) <= low))


def activity_by_type(phi: DataFrame, cells: DataFrame, column: str = "cell_type", n: int = 15) -> DataFrame:
    """Mean activity per (label, factor): the n largest of each factor."""
    means = phi.join(cells.select("cell_id", column), "cell_id").groupBy(column, "factor_idx").agg(
        F.avg("phi").alias("mean_phi")
    )
    return top_per_group(means, ["factor_idx"], [F.desc("mean_phi"), F.asc(column)], n)


def activity_variance(phi: DataFrame, n: int | None = 3) -> DataFrame:
    """Factors by the variance (ddof = 0) of their activity."""
    ranked = phi.groupBy("factor_idx").agg(F.var_pop("phi").alias("variance")).orderBy(
        F.desc("variance"), F.asc("factor_idx")
    )
    return ranked if n is None else ranked.limit(n)


def histogram(df: DataFrame, value: str, group: list[str], bins: int) -> DataFrame:
    """Counts in equal bins between the group's minimum and maximum; the last bin is closed.

    Empty bins appear with count 0. A constant group gets a range of width 1
    around its value. The bounds are written first, so Spark knows their size: up to the broadcast threshold rows are counted where they
    are and only (group, bin) counts move; more groups than that are joined by key.
    """
    bounds = df.groupBy(*group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    bounds = bounds.select(
        *group,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("hi"),
    ).filter(F.col("lo").isNotNull())
    bounds = materialise(bounds, "bounds")
    keyed = df.withColumn("_all", F.lit(0)) if not group else df
    keys = group or ["_all"]
    if not group:
        bounds = bounds.withColumn("_all", F.lit(0))
    place = F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1
    counts = (
        keyed.filter(F.col(value).isNotNull())
        .join(bounds, keys)
        .groupBy(*keys, F.least(F.lit(bins), place).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = bounds.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, [*keys, "bin"], "left").select(
        *group,
        "bin",
        (F.col("lo") + width * (F.col("bin") - 1)).alias("left_edge"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def activity_histogram(phi: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(phi, "phi", ["factor_idx"], bins)


def mean_count_histogram(mean_counts: DataFrame, bins: int = 100) -> DataFrame:
    """Histogram of log10 of the mean count per junction (junctions with reads)."""
    logs = mean_counts.filter(F.col("mean_count") > 0).select(F.log10("mean_count").alias("log_mean"))
    return histogram(logs, "log_mean", [], bins)


def type_counts(df: DataFrame, column: str = "cell_type") -> DataFrame:
    """Rows per label, most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column))


def psi_quartiles(obs: DataFrame, cells: DataFrame, column: str = "cell_type", per_junction: bool = True) -> DataFrame:
    """Quartiles, mean and count of the observed usage by label (and junction)."""
    labelled = observed_psi(obs).join(cells.select("cell_id", column), "cell_id")
    return exact_quantiles(labelled, [column] + (["junction_id"] if per_junction else []), "psi", QUARTILES)


def reference_vs_others(psi_samples: DataFrame, ref_factor: int, junction_id=None) -> DataFrame:
    """Distribution of sampled psi in one factor against all other factors.

    One junction if given, else every junction.
    """
    rows = psi_samples if junction_id is None else psi_samples.filter(F.col("junction_id") == junction_id)
    side = F.when(F.col("factor_idx") == ref_factor, "Reference Factor").otherwise("Other Factors")
    return exact_quantiles(rows.withColumn("group", side), ["junction_id", "group"], "psi", QUARTILES)


def activity_wide(phi: DataFrame, k: int, prefix: str = "SP_") -> DataFrame:
    """One row per cell with columns SP_1 .. SP_K."""
    return phi.groupBy("cell_id").agg(
        *[F.max(F.when(F.col("factor_idx") == i, F.col("phi"))).alias(f"{prefix}{i + 1}") for i in range(k)]
    )


def export_activities(phi: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """The cell table with the activities as additional columns."""
    return cells.join(activity_wide(phi, k), "cell_id", "left")


def activity_box(wide_cells: DataFrame, column: str = "cell_type", prefix: str = "SP_") -> DataFrame:
    """Quartiles, mean and count of every program's activity by label, from the wide table."""
    programs = [c for c in wide_cells.columns if c.startswith(prefix)]
    long = wide_cells.unpivot(["cell_id", column], programs, "program", "activity")
    return exact_quantiles(long, [column, "program"], "activity", QUARTILES)


def score_table(psi_params: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """One row per junction: psi, mu and loc of every factor, with the junction's score.

    ``psi_params`` has ``psi``, ``mu`` and ``loc`` per (factor, junction).
    """
    slots = []
    for i in range(k):
        here = F.col("factor_idx") == i
        slots += [F.max(F.when(here, F.col(c))).alias(f"{c}_{i}") for c in ("psi", "mu", "loc")]
    return psi_params.groupBy("junction_id").agg(*slots).join(scores, "junction_id")
