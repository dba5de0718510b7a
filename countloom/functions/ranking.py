"""Ranks, running sums and exact quantiles that never put a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countloom.storage import materialise


#: Above this number of rows Spark no longer limits a group before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
_GROUP_LIMIT = 1000


def with_running(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    sums: dict[str, Column] | None = None,
    partitions: int | None = None,
    counted: dict[str, Column] | None = None,
) -> DataFrame:
    """Add ``rank``, ``group_rows`` and, for each name in ``sums``, the running sum ``name`` and ``name_total``.

    For each name in ``counted`` the number of the group's rows that meet the
    condition is added; the condition may use the rank and the sums.

    A plain window over ``group`` would send a whole group to one task, however
    large. Here the rows are split into ranges of (group, order), each range
    is summed on its own, and the sums of the ranges before it are added. What a
    group has in all also comes back by range, so rows are never joined by group
    alone. Rows must differ in ``order`` within a group for the rank to be well
    defined. A null group is a group.
    """
    sums, counted = sums or {}, counted or {}
    # Without a number, adaptive execution may merge neighbouring ranges of little data.
    number = [partitions] if partitions else []
    weights = {f"_w_{name}": expr for name, expr in sums.items()}
    ranged = (
        df.withColumns(weights)
        .repartitionByRange(*number, *[F.col(g) for g in group], *order)
        .withColumn("_part", F.spark_partition_id())
        # One key for the group: equal structs may hold nulls, so the windows, sums and joins below share one partitioning.
        .withColumn("_key", F.struct(*group) if group else F.struct(F.lit(0)))
    )
    # The split must not change between its two uses below, so it is written.
    ranged = materialise(ranged, "ranges")

    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_key")
    per_range = ranged.groupBy("_part", "_key").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(f"_w_{name}").alias(f"_t_{name}") for name in sums]
    )
    offsets = per_range.select(
        "_part",
        "_key",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_rows").over(whole).alias("group_rows"),
        *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0.0)).alias(f"_before_{name}") for name in sums],
        *[F.sum(f"_t_{name}").over(whole).alias(f"{name}_total") for name in sums],
    )

    within = Window.partitionBy("_part", "_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumns(
        {
            "_rank": F.count(F.lit(1)).over(within),
            **{f"_run_{name}": F.sum(f"_w_{name}").over(within) for name in sums},
        }
    )
    out = local.join(offsets, ["_part", "_key"]).select(
        "_part",
        "_key",
        *df.columns,
        (F.col("_rank") + F.col("_rows_before")).alias("rank"),
        "group_rows",
        *[(F.col(f"_run_{name}") + F.col(f"_before_{name}")).alias(name) for name in sums],
        *[f"{name}_total" for name in sums],
    )
    if counted:
        met = out.groupBy("_part", "_key").agg(*[F.count_if(condition).alias(name) for name, condition in counted.items()])
        met = met.select("_part", "_key", *[F.sum(name).over(whole).alias(name) for name in counted])
        out = out.join(met, ["_part", "_key"])
    return out.drop("_part", "_key")


def exact_quantiles(df: DataFrame, group: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles with ``n`` and ``mean`` per group.

    Equal values are first collapsed to (value, count), combined on the map
    side; the few rows around each target position are then picked out of the
    distributed running count.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_count"))
    run = with_running(
        counted,
        group,
        [F.col(value)],
        {"_cum": F.col("_count").cast("double"), "_sum": F.col(value) * F.col("_count")},
    )
    first = F.col("_cum") - F.col("_count")
    picks = []
    for name, q in quantiles.items():
        position = F.lit(q) * (F.col("_cum_total") - 1)
        for tag, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (first <= index) & (index < F.col("_cum"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{tag}_{name}"))
    picked = run.groupBy(*group).agg(
        F.max("_cum_total").cast("long").alias("n"),
        (F.max("_sum_total") / F.max("_cum_total")).alias("mean"),
        *picks,
    )
    out = []
    for name, q in quantiles.items():
        position = F.lit(q) * (F.col("n") - 1)
        part = position - F.floor(position)
        out.append((F.col(f"_lo_{name}") + part * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    return picked.select(*group, "n", "mean", *out)


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group.

    Spark keeps only ``n`` rows per group and map task before the shuffle
    (window group limit), so a hot group does not reach one task whole. It does
    not for more than 1,000 rows; then the first ``n`` of every input partition
    are taken first, in tasks of their own.
    """
    if n > _GROUP_LIMIT:
        part = Window.partitionBy("_part", *group).orderBy(*order)
        df = df.withColumn("_part", F.spark_partition_id()).withColumn("_first", F.row_number().over(part))
        df = df.filter(F.col("_first") <= n).drop("_part", "_first")
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
