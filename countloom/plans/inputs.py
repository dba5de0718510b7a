"""Count data and posterior-like tables derived from the order tables.

A cell is a customer, an ATSE a brand, a junction a (brand, type), a count the
number of line items. Factors are the five order priorities and samples the
order years, so psi and phi tables are ratios of real counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: (cell_id, atse_id, junction_id, factor_idx, sample)."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("cell_id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("factor_idx"),
        F.year("o_orderdate").alias("sample"),
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_brand").alias("atse_id"),
        F.concat_ws("|", "p_brand", "p_type").alias("junction_id"),
    )
    return items.join(orders, "l_orderkey").join(parts, "l_partkey").drop("l_orderkey", "l_partkey")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, atse_id, junction_id, y)."""
    rows = purchases(spark, sf_dir).groupBy("cell_id", "atse_id", "junction_id")
    return rows.agg(F.count(F.lit(1)).cast("double").alias("y"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, cell_type, tissue, partial_label); the last one is NULL for one segment."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cell_id"),
        F.col("c_mktsegment").alias("cell_type"),
        F.col("c_nationkey").cast("string").alias("tissue"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("partial_label"),
    )


def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(junction_id, atse_id, gene_id, gene_name); ECONOMY types have no gene name."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    return rows.select(
        F.concat_ws("|", "p_brand", "p_type").alias("junction_id"),
        F.col("p_brand").alias("atse_id"),
        F.col("p_brand").alias("gene_id"),
        F.when(F.col("p_type") != "ECONOMY", F.lower(F.concat_ws(" ", "p_brand", "p_type"))).alias("gene_name"),
    )


def _usage(rows: DataFrame, keys: list[str]) -> DataFrame:
    per_junction = rows.groupBy(*keys, "atse_id", "junction_id").agg(F.count(F.lit(1)).cast("double").alias("y"))
    per_atse = per_junction.groupBy(*keys, "atse_id").agg(F.sum("y").alias("n"))
    return per_junction.join(per_atse, [*keys, "atse_id"]).select(
        *keys, "junction_id", (F.col("y") / F.col("n")).alias("psi")
    )


def _shares(rows: DataFrame, keys: list[str]) -> DataFrame:
    per_factor = rows.groupBy(*keys, "factor_idx").agg(F.count(F.lit(1)).cast("double").alias("y"))
    whole = per_factor.groupBy(*keys).agg(F.sum("y").alias("n"))
    return per_factor.join(whole, keys).select(*keys, "factor_idx", (F.col("y") / F.col("n")).alias("phi"))


def psi_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, factor_idx, junction_id, psi)."""
    return _usage(purchases(spark, sf_dir), ["sample", "factor_idx"])


def phi_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, cell_id, factor_idx, phi)."""
    return _shares(purchases(spark, sf_dir), ["sample", "cell_id"])


def psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(factor_idx, junction_id, psi)."""
    return _usage(purchases(spark, sf_dir), ["factor_idx"])


def phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, factor_idx, phi)."""
    return _shares(purchases(spark, sf_dir), ["cell_id"])


def pi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(factor_idx, pi)."""
    rows = purchases(spark, sf_dir).groupBy("factor_idx").agg(F.count(F.lit(1)).cast("double").alias("y"))
    return rows.select("factor_idx", (F.col("y") / rows.agg(F.sum("y").alias("n")).scalar()).alias("pi"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, n_epochs, final_loss): one run per order year, the loss being the mean order price."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.year("o_orderdate").alias("run_id"))
        .agg(F.count(F.lit(1)).alias("n_epochs"), F.avg("o_totalprice").alias("final_loss"))
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, label, coords) from the embeddings."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cell_id"),
        F.col("label"),
        F.col("embedding").cast("array<double>").alias("coords"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(junction_id, score): log2 ratio of the largest to the smallest usage over priorities, minus 1/2."""
    usage = psi(spark, sf_dir)
    return usage.groupBy("junction_id").agg(
        (F.log2(F.max("psi") / F.min("psi")) * 4 - F.lit(0.5)).alias("score")
    )
