"""Counts, group totals, usage ratios and their filters.

Joins here are plain equi-joins without hints: Spark broadcasts a side only
after checking its size, and adaptive execution splits hot keys otherwise. Per
key statistics are aggregated first (combined on the map side) and then joined; a window over fact
rows is used only where its groups are bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countloom.functions.vectors import clamp, hashed_order
from countloom.schema import CLUSTER_LAYER, JUNCTION_LAYER, Dataset


def sum_by(counts: DataFrame, key: str, value: str = "y", keys: DataFrame | None = None) -> DataFrame:
    """Sum of ``value`` per ``key``. With ``keys``, keys without entries appear with 0."""
    sums = counts.groupBy(key).agg(F.sum(value).alias("total"))
    if keys is None:
        return sums
    return keys.select(key).join(sums, key, "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def merge_duplicates(counts: DataFrame) -> DataFrame:
    """Entries stored more than once for a (cell, junction) are added up."""
    return counts.groupBy("cell_id", "junction_id").agg(F.sum("y").alias("y"))


def atse_totals(counts: DataFrame, junctions: DataFrame | None = None) -> DataFrame:
    """Total count n of every (cell, ATSE) that has any entry."""
    if "atse_id" not in counts.columns:
        counts = counts.join(junctions.select("junction_id", "atse_id"), "junction_id")
    return counts.groupBy("cell_id", "atse_id").agg(F.sum("y").alias("n"))


def cluster_layer(totals: DataFrame, junctions: DataFrame) -> DataFrame:
    """The totals spread to every junction of the ATSE, including those without reads."""
    return totals.join(junctions.select("junction_id", "atse_id"), "atse_id").select(
        "cell_id", "junction_id", "atse_id", "n"
    )


def with_totals(counts: DataFrame) -> DataFrame:
    """Stored entries (with ``atse_id``) and their ATSE total n in the same cell.

    A (cell, ATSE) group holds no more entries than the ATSE has junctions, so this window is bounded.
    """
    group = Window.partitionBy("cell_id", "atse_id")
    others = [c for c in counts.columns if c not in ("cell_id", "atse_id")]
    return counts.select("cell_id", "atse_id", *others, F.sum("y").over(group).alias("n"))


def observed_entries(dataset: Dataset, include_zeros: bool = False) -> DataFrame:
    """The central fact table (cell_id, junction_id, atse_id, y, n).

    One row per stored junction entry; n is looked up and 0 where the total is
    missing. ``include_zeros`` adds the entries with y = 0 and n > 0.
    """
    totals = dataset.layer(CLUSTER_LAYER)
    counts = merge_duplicates(dataset.layer(JUNCTION_LAYER))
    labelled = counts.join(dataset.junctions.select("junction_id", "atse_id"), "junction_id", "left")
    per_atse = "junction_id" not in totals.columns
    keys = ["cell_id", "atse_id"] if per_atse else ["cell_id", "junction_id"]
    if not include_zeros:
        joined = labelled.join(totals.select(*keys, "n"), keys, "left")
    else:
        full = cluster_layer(totals, dataset.junctions) if per_atse else totals
        if "atse_id" in full.columns:
            full = full.drop("atse_id")
        full = full.filter(F.col("n") > 0)
        joined = (
            counts.join(full, ["cell_id", "junction_id"], "full")
            .join(dataset.junctions.select("junction_id", "atse_id"), "junction_id", "left")
            .withColumn("y", F.coalesce("y", F.lit(0.0)))
        )
    return joined.select("cell_id", "junction_id", "atse_id", "y", F.coalesce("n", F.lit(0.0)).alias("n"))


def observed_psi(obs: DataFrame) -> DataFrame:
    """Usage ratio y / n where the total is not 0."""
    return obs.filter(F.col("n") != 0).withColumn("psi", F.col("y") / F.col("n"))


def precision_weight(rho: float = 0.1):
    """Weight n / (1 + (n - 1) rho): the inverse beta-binomial variance."""
    return F.col("n") / (F.lit(1.0) + (F.col("n") - 1) * F.lit(rho))


def junction_means(obs: DataFrame, rho: float = 0.1) -> DataFrame:
    """Weighted mean usage of every junction."""
    weighted = observed_psi(obs).withColumn("w", precision_weight(rho))
    return weighted.groupBy("junction_id").agg(
        (F.sum(F.col("w") * F.col("psi")) / F.sum("w")).alias("junction_mean")
    )


def centered_psi(obs: DataFrame, rho: float = 0.1) -> DataFrame:
    """Usage minus the weighted junction mean, with all intermediate columns."""
    base = observed_psi(obs).withColumn("w", precision_weight(rho)).withColumn("w_psi", F.col("w") * F.col("psi"))
    return base.join(junction_means(obs, rho), "junction_id").withColumn(
        "centered", F.col("psi") - F.col("junction_mean")
    )


def mean_counts(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Mean count per junction over all cells, those without reads included."""
    n_cells = cells.select(F.count(F.lit(1)).alias("n")).scalar()
    return counts.groupBy("junction_id").agg(F.sum("y").alias("total")).withColumn(
        "mean_count", F.try_divide("total", n_cells)
    )


def keep_mask(counts: DataFrame, cells: DataFrame, junctions: DataFrame, min_junc_mean: float = 0.005) -> DataFrame:
    """Every junction with its mean count and whether it passes the (strict) threshold."""
    means = junctions.select("junction_id").join(mean_counts(counts, cells), "junction_id", "left")
    mean = F.coalesce("mean_count", F.lit(0.0))
    return means.select("junction_id", mean.alias("mean_count"), (mean > min_junc_mean).alias("keep"))


def filter_junctions(
    counts: DataFrame, totals: DataFrame, cells: DataFrame, junctions: DataFrame, min_junc_mean: float = 0.005
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop rare junctions from both layers; also returns the keep mask.

    ``totals`` may be per junction, or per ATSE, in which case a total stays as
    long as one junction of its ATSE does.
    """
    mask = keep_mask(counts, cells, junctions, min_junc_mean)
    kept = mask.filter("keep").select("junction_id")
    if "junction_id" in totals.columns:
        totals_kept = totals.join(kept, "junction_id", "left_semi")
    else:
        atses = junctions.join(kept, "junction_id", "left_semi").select("atse_id").distinct()
        totals_kept = totals.join(atses, "atse_id", "left_semi")
    return counts.join(kept, "junction_id", "left_semi"), totals_kept, mask


def top_junctions(counts: DataFrame, n: int) -> DataFrame:
    """The n junctions with the largest total count; ties by junction_id."""
    return (
        counts.groupBy("junction_id")
        .agg(F.sum("y").alias("total"))
        .orderBy(F.desc("total"), F.asc("junction_id"))
        .limit(n)
    )


def restrict(df: DataFrame, wanted: DataFrame, key: str = "junction_id") -> DataFrame:
    """Rows whose key occurs in ``wanted``."""
    return df.join(wanted.select(key), key, "left_semi")


def sample_cells(cells: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A seeded random subset of min(n, all) cells without replacement."""
    return cells.orderBy(hashed_order("cell_id", F.lit(seed)), F.asc("cell_id")).limit(n)


def where_in(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose ``column`` is one of ``values`` (an equality pushes down to the scan)."""
    return df.filter(F.col(column) == values[0]) if len(values) == 1 else df.filter(F.col(column).isin(*values))


def density(counts: DataFrame, cells: DataFrame, junctions: DataFrame) -> DataFrame:
    """Stored entries, their share of all cells x junctions, and the share of zeros."""
    n_cells = cells.select(F.count(F.lit(1)).alias("n")).scalar()
    n_junctions = junctions.select(F.count(F.lit(1)).alias("n")).scalar()
    out = counts.agg(F.count(F.lit(1)).alias("nnz")).select(
        "nnz", n_cells.alias("n_cells"), n_junctions.alias("n_junctions")
    )
    share = F.try_divide(F.col("nnz").cast("double"), F.col("n_cells") * F.col("n_junctions"))
    return out.withColumn("density", share).withColumn("sparsity", F.lit(1.0) - share)


def violations(obs: DataFrame) -> DataFrame:
    """One row of violation counts of the data invariants; all 0 for valid data.

    ``sum_mismatch`` and ``n_differs`` are checked per (cell, ATSE) and count groups.
    """
    per_group = obs.groupBy("cell_id", "atse_id").agg(
        F.count_if((F.col("y") > 0) & ~(F.col("n") > 0)).alias("y_without_n"),
        F.count_if(F.isnan("y") | F.isnan("n") | F.col("y").isNull() | F.col("n").isNull()).alias("not_finite"),
        F.count_if((F.col("y") < 0) | (F.col("y") > F.col("n"))).alias("out_of_range"),
        F.sum("y").alias("sum_y"),
        F.min("n").alias("min_n"),
        F.max("n").alias("max_n"),
    )
    return per_group.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("y_without_n", "not_finite", "out_of_range")],
        F.count_if(F.col("min_n") != F.col("max_n")).alias("n_differs"),
        F.count_if(F.abs(F.col("sum_y") - F.col("max_n")) > 1e-9).alias("sum_mismatch"),
    )


def assert_valid(obs: DataFrame) -> None:
    """Raise ValueError naming the broken invariants, if any."""
    broken = {k: v for k, v in violations(obs).first().asDict().items() if v}
    if broken:
        raise ValueError(f"invalid count data: {broken}")


def clamp_probability(column: str, eps: float = 1e-6):
    return clamp(F.col(column), eps, 1 - eps)


def lookup(wanted: DataFrame, table: DataFrame, value: str, key: str = "junction_id") -> DataFrame:
    """First ``value`` (smallest, so that it is well defined) of every wanted key; inner join."""
    found = table.groupBy(key).agg(F.min(value).alias(value))
    return wanted.select(key).distinct().join(found, key)


def lookup_one(table: DataFrame, key_value, value: str, key: str = "junction_id"):
    """The value for one key; KeyError if there is none."""
    row = table.filter(F.col(key) == key_value).agg(F.min(value).alias(value), F.count(F.lit(1)).alias("n")).first()
    if row["n"] == 0:
        raise KeyError(key_value)
    return row[value]


def annotate(df: DataFrame, junctions: DataFrame) -> DataFrame:
    """Add ``label``: the gene name where the table has one, else the junction id."""
    if "gene_name" not in junctions.columns:
        return df.withColumn("label", F.col("junction_id").cast("string"))
    names = junctions.select("junction_id", "gene_name")
    return df.join(names, "junction_id", "left").withColumn(
        "label", F.coalesce("gene_name", F.col("junction_id").cast("string"))
    )


def attach_labels(activities: DataFrame, cells: DataFrame, columns: list[str]) -> DataFrame:
    """Cell metadata joined to activities by cell."""
    return activities.join(cells.select("cell_id", *columns), "cell_id")


# The label prefix cut off, and the one label that is broken over two lines.
LABEL_PREFIX = "Myeloid_"
LONG_LABEL = "oligodendrocyte_precursor_cell"
LONG_LABEL_BROKEN = "oligodendrocyte_\nprecursor_cell"


def clean_label(column: str):
    """Display form of a cell type label."""
    return F.replace(
        F.substring_index(F.col(column), LABEL_PREFIX, -1), F.lit(LONG_LABEL), F.lit(LONG_LABEL_BROKEN)
    )
