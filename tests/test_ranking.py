import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from countloom.functions.ranking import QUARTILES, exact_quantiles, top_per_group, with_running


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_running_matches_pandas(spark, parts):
    rng = np.random.default_rng(parts)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 400, p=[0.8, 0.15, 0.05]), "k": np.arange(400), "v": rng.random(400)})
    out = with_running(
        spark.createDataFrame(pdf).repartition(5), ["g"], [F.desc("k")], {"run": F.col("v")}, partitions=parts
    ).toPandas()
    want = pdf.sort_values("k", ascending=False)
    want["run"] = want.groupby("g")["v"].cumsum()
    want["rank"] = want.groupby("g").cumcount() + 1
    got = out.set_index("k").loc[want["k"]]
    assert (got["rank"].to_numpy() == want["rank"].to_numpy()).all()
    assert got["run"].to_numpy() == pytest.approx(want["run"].to_numpy())
    assert got["run_total"].to_numpy() == pytest.approx(want.groupby("g")["v"].transform("sum").to_numpy())
    assert (got["group_rows"].to_numpy() == want.groupby("g")["v"].transform("size").to_numpy()).all()


def test_running_without_groups_and_with_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), ("x", 3, 4.0)], "g string, k int, v double")
    rows = with_running(df, [], [F.asc("k")], {"s": F.col("v")}).orderBy("k").collect()
    assert [r.s for r in rows] == [1.0, 3.0, 7.0]
    rows = with_running(df, ["g"], [F.asc("k")], {"s": F.col("v")}).orderBy("k").collect()
    assert [r.s for r in rows] == [1.0, 3.0, 4.0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 6)), min_size=1, max_size=40))
def test_quantiles_match_numpy(spark, rows):
    df = spark.createDataFrame([(g, v / 7) for g, v in rows], "g string, v double")
    for r in exact_quantiles(df, ["g"], "v", QUARTILES).collect():
        values = [v / 7 for g, v in rows if g == r.g]
        assert (r.q25, r.q50, r.q75) == pytest.approx(tuple(np.quantile(values, [0.25, 0.5, 0.75])))
        assert r.n == len(values) and r["mean"] == pytest.approx(np.mean(values))


def test_top_per_group_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id AS v")
    top = top_per_group(df, ["g"], [F.desc("v")], 2)
    assert sorted((r.g, r.v) for r in top.collect()) == [(0, 996), (0, 999), (1, 994), (1, 997), (2, 995), (2, 998)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_counts_of_a_group_join_by_range(spark):
    """What a group has in all comes back by (range, group), so no join or window of the rows goes by the group alone."""
    rows = [("hot" if k % 10 else None, k, k / 500) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = with_running(df, ["g"], [F.asc("k")], {"s": F.col("v")}, partitions=4, counted={"met": F.col("s") / F.col("rank") > 0.3})
        got = {r.k: (r.s, r.met) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
    assert joins and all("_part" in line for line in joins)
    for hot in (True, False):
        ks = [k for k in range(500) if (k % 10 > 0) == hot]
        runs = np.cumsum([k / 500 for k in ks])
        met = int((runs / np.arange(1, len(ks) + 1) > 0.3).sum())
        assert all(got[k] == (pytest.approx(run), met) for k, run in zip(ks, runs))


def test_top_of_a_hot_group_beyond_the_group_limit(spark):
    df = spark.range(6000).selectExpr("IF(id % 3 = 0, 1, 0) AS g", "id AS v").repartition(5)
    top = top_per_group(df, ["g"], [F.desc("v")], 1500).collect()
    for g in (0, 1):
        want = sorted((k for k in range(6000) if (k % 3 == 0) == (g == 1)), reverse=True)[:1500]
        assert sorted((r["rank"], r.v) for r in top if r.g == g) == list(enumerate(want, 1))
