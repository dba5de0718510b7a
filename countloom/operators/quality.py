"""Agreement between runs, and separation of labels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.functions.gram import gram
from countloom.storage import materialise


def factor_correlations(phi: DataFrame, k: int) -> DataFrame:
    """Pearson correlation of every factor of run_a with every factor of run_b < run_a.

    ``phi`` has rows (run_id, cell_id, factor_idx, phi); an absent row is
    activity 0. Cells become one array of runs x factors numbers, and the cross
    products of these arrays are summed per task, so no pair of rows is formed.
    """
    run_ids = [r.run_id for r in phi.select("run_id").distinct().orderBy("run_id").collect()]
    size = len(run_ids) * k
    slots = [
        F.max(F.when((F.col("run_id") == run) & (F.col("factor_idx") == i), F.col("phi"))).alias(f"_s{p * k + i}")
        for p, run in enumerate(run_ids)
        for i in range(k)
    ]
    one_and_slots = F.array(F.lit(1.0), *[F.coalesce(F.col(f"_s{s}"), F.lit(0.0)) for s in range(size)])
    cells = phi.groupBy("cell_id").agg(*slots).select(one_and_slots.alias("v"))
    products = materialise(gram(cells, "v", size + 1), "gram")
    first = products.filter(F.col("i") == 0)
    n = first.filter(F.col("j") == 0).select("value").scalar()
    sums = first.select(F.col("j").alias("s"), (F.col("value") / n).alias("mean"))
    squares = products.filter(F.col("i") == F.col("j")).select(F.col("i").alias("s"), (F.col("value") / n).alias("sq"))
    moments = sums.join(squares, "s").select("s", "mean", (F.col("sq") - F.col("mean") ** 2).alias("var"))
    pairs = products.filter((F.col("i") > 0) & (F.col("j") > 0)).select("i", "j", (F.col("value") / n).alias("xy"))
    left = moments.select(F.col("s").alias("i"), F.col("mean").alias("mi"), F.col("var").alias("vi"))
    right = moments.select(F.col("s").alias("j"), F.col("mean").alias("mj"), F.col("var").alias("vj"))
    runs = F.array(*[F.lit(r) for r in run_ids])
    joined = pairs.join(left, "i").join(right, "j")
    scale = F.sqrt(F.col("vi") * F.col("vj"))
    return joined.select(
        runs[F.floor((F.col("i") - 1) / k).cast("int")].alias("run_a"),
        runs[F.floor((F.col("j") - 1) / k).cast("int")].alias("run_b"),
        F.pmod(F.col("i") - 1, F.lit(k)).alias("factor_a"),
        F.pmod(F.col("j") - 1, F.lit(k)).alias("factor_b"),
        F.when(scale > 0, (F.col("xy") - F.col("mi") * F.col("mj")) / scale).alias("corr"),
    ).filter(F.col("run_b") < F.col("run_a"))


def match_factors(correlations: DataFrame) -> DataFrame:
    """Greedy one-to-one matching of factors per pair of runs, best correlation first.

    Each pair of runs is one group of K x K rows.
    """

    def greedy(pairs: pd.DataFrame) -> pd.DataFrame:
        ordered = pairs.sort_values(["corr", "factor_a", "factor_b"], ascending=[False, True, True])
        used_a, used_b, keep = set(), set(), []
        for a, b in zip(ordered["factor_a"], ordered["factor_b"]):
            free = a not in used_a and b not in used_b
            keep.append(free)
            if free:
                used_a.add(a)
                used_b.add(b)
        return ordered[keep]

    return correlations.groupBy("run_a", "run_b").applyInPandas(greedy, correlations.schema)


def run_correlation(phi: DataFrame, k: int) -> DataFrame:
    """Mean correlation over matched factors for every pair run_b < run_a."""
    matched = match_factors(factor_correlations(phi, k))
    return matched.groupBy("run_a", "run_b").agg(F.avg("corr").alias("corr"))


def pairwise_stats(correlations: DataFrame) -> DataFrame:
    """Mean, median and minimum over the strict lower triangle of runs."""
    return correlations.filter(F.col("run_b") < F.col("run_a")).agg(
        F.avg("corr").alias("average"), F.median("corr").alias("median"), F.min("corr").alias("minimum")
    )


def silhouette_cells(points: DataFrame, rows_per_block: int = 20_000) -> DataFrame:
    """Exact Euclidean silhouette of every point ``(cell_id, label, coords)``.

    The distances of all pairs are inherent to this measure. Points are hashed
    into g blocks, and each of the g x g block pairs is one task that reduces its
    distances to one sum per (point, label); no pair leaves a task and a task
    holds two blocks. Cost grows with the square of the points: for large data
    use ``silhouette_squared``.
    """
    n = points.count()
    g = max(1, math.ceil(n / rows_per_block), min(8, math.ceil(n / 500)))
    block = F.pmod(F.xxhash64("cell_id"), F.lit(g)).cast("int")
    base = points.withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    rows = base.withColumn("other", other).withColumnRenamed("block", "bi").withColumnRenamed("other", "bj")
    cols = base.withColumn("other", other).withColumnRenamed("block", "bj").withColumnRenamed("other", "bi")
    label_type = dict(points.dtypes)["label"]
    id_type = dict(points.dtypes)["cell_id"]

    def block_pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            x = np.stack(left["coords"].to_numpy())
            by_label = {
                label: np.stack(group["coords"].to_numpy()) for label, group in right.groupby("label", sort=False)
            }
            for start in range(0, len(x), 256):
                chunk = x[start : start + 256]
                ids = left["cell_id"].to_numpy()[start : start + 256]
                own = left["label"].to_numpy()[start : start + 256]
                for label, y in by_label.items():
                    sq = (chunk**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2.0 * chunk @ y.T
                    dist = np.sqrt(np.maximum(sq, 0.0))
                    parts.append(
                        pd.DataFrame(
                            {"cell_id": ids, "label": own, "towards": label, "total": dist.sum(1), "n": len(y)}
                        )
                    )
        columns = ["cell_id", "label", "towards", "total", "n"]
        return pd.concat(parts) if parts else pd.DataFrame(columns=columns)

    sums = (
        rows.groupBy("bi", "bj")
        .cogroup(cols.groupBy("bi", "bj"))
        .applyInPandas(
            block_pair, f"cell_id {id_type}, label {label_type}, towards {label_type}, total double, n long"
        )
    )
    means = sums.groupBy("cell_id", "label", "towards").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return _silhouette_from_sums(means)


def _silhouette_from_sums(sums: DataFrame) -> DataFrame:
    """Silhouette from per (point, label) distance sums; the own label's n includes the point itself."""
    own = F.col("towards") == F.col("label")
    per_cell = sums.groupBy("cell_id", "label").agg(
        F.max(F.when(own, F.col("n"))).alias("own_n"),
        F.max(F.when(own, F.col("total"))).alias("own_total"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    a = F.col("own_total") / (F.col("own_n") - 1)
    wide = per_cell.withColumn("a", F.when(F.col("own_n") > 1, a))
    peak = F.greatest("a", "b")
    score = F.when((F.col("own_n") > 1) & (peak > 0), (F.col("b") - F.col("a")) / peak).otherwise(0.0)
    return wide.select("cell_id", "label", "a", "b", score.alias("silhouette"))


def silhouette_squared_cells(points: DataFrame, dims: int) -> DataFrame:
    """Silhouette with squared Euclidean distances, in time linear in the points.

    Sum over q in L of |p - q|^2 = n_L |p|^2 - 2 p . S_L + Q_L, so one small
    row (n, S, Q) per label replaces all pairs.
    """
    norm = F.aggregate(F.col("coords"), F.lit(0.0), lambda acc, v: acc + v * v)
    whole = F.size("coords") == dims
    base = points.withColumn("_sq", F.when(whole, norm).otherwise(F.raise_error(F.lit(f"coords must have {dims} values"))))
    labels = base.groupBy(F.col("label").alias("towards")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_sq").alias("q"),
        *[F.sum(F.col("coords")[d]).alias(f"_d{d}") for d in range(dims)],
    )
    packed = labels.select(
        F.struct("towards", "n", "q", F.array(*[f"_d{d}" for d in range(dims)]).alias("s")).alias("_label")
    )
    all_labels = packed.agg(F.collect_list("_label").alias("ls")).scalar()
    spread = base.withColumn("_l", F.explode(all_labels))
    cross = F.aggregate(F.zip_with("coords", "_l.s", lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)
    total = F.col("_l.n") * F.col("_sq") - F.lit(2.0) * cross + F.col("_l.q")
    sums = spread.select(
        "cell_id", "label", F.col("_l.towards").alias("towards"), F.col("_l.n").alias("n"),
        F.greatest(F.lit(0.0), total).alias("total"),
    )
    return _silhouette_from_sums(sums)


def silhouette_score(cells: DataFrame) -> DataFrame:
    """Mean silhouette over points."""
    return cells.agg(F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("n_cells"))
