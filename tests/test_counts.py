import numpy as np
import pytest
from data import WORKED_ATSE, WORKED_Y, synthetic, tables

from countloom.operators import counts as C
from countloom.operators import summaries as S
from countloom.schema import CLUSTER_LAYER, JUNCTION_LAYER, Dataset

APPROX = dict(abs=1e-6)


@pytest.fixture(scope="module")
def worked(spark):
    return tables(spark, WORKED_Y, WORKED_ATSE)


def test_totals_of_the_worked_example(worked):
    rows = {(r.cell_id, r.atse_id): r.n for r in C.atse_totals(worked[0]).collect()}
    assert [(rows[c, 0], rows[c, 1]) for c in range(6)] == [(5, 3), (8, 7), (2, 8), (2, 6), (3, 9), (6, 1)]


def test_totals_from_the_junction_table(worked):
    counts, _, junctions = worked
    direct = C.atse_totals(counts).collect()
    joined = C.atse_totals(counts.drop("atse_id"), junctions).collect()
    assert sorted(direct) == sorted(joined)


def test_density_and_means(worked):
    counts, cells, junctions = worked
    row = C.density(counts, cells, junctions).first()
    assert (row.nnz, row.density, row.sparsity) == (18, 0.6, 0.4)
    means = {r.junction_id: r.mean_count for r in C.mean_counts(counts, cells).collect()}
    assert [means[j] for j in range(5)] == pytest.approx([2.0, 7 / 3, 4 / 3, 13 / 6, 13 / 6])
    assert C.cluster_layer(C.atse_totals(counts), junctions).count() == 30


def test_weighted_means_and_centred_usage(worked):
    obs = C.with_totals(worked[0])
    means = {r.junction_id: r.junction_mean for r in C.junction_means(obs).collect()}
    assert [means[j] for j in range(5)] == pytest.approx([0.799923, 0.72545, 0.721088, 0.662222, 0.448376], **APPROX)
    centred = {(r.cell_id, r.junction_id): r.centered for r in C.centered_psi(obs).collect()}
    want = {
        (0, 0): 0.200077, (0, 2): -0.054422, (0, 3): -0.328889,
        (1, 1): 0.27455, (1, 4): 0.551624,
        (2, 0): -0.299923, (2, 1): -0.22545, (2, 2): 0.028912, (2, 4): -0.198376,
        (3, 0): 0.200077, (3, 3): -0.162222, (3, 4): 0.051624,
        (4, 1): 0.27455, (4, 3): 0.226667, (4, 4): -0.337264,
        (5, 0): -0.133256, (5, 1): -0.392117, (5, 3): 0.337778,
    }
    assert centred.keys() == want.keys()
    assert [centred[k] for k in want] == pytest.approx(list(want.values()), **APPROX)


def _dataset(worked, totals=None):
    counts, cells, junctions = worked
    layers = {JUNCTION_LAYER: counts.drop("atse_id"), CLUSTER_LAYER: totals or C.atse_totals(counts)}
    return Dataset(cells, junctions, layers)


def test_observed_entries_and_zeros(worked):
    stored = C.observed_entries(_dataset(worked))
    assert stored.count() == 18
    full = C.observed_entries(_dataset(worked), include_zeros=True)
    assert full.count() == 30
    assert full.filter("y = 0").count() == 12
    C.assert_valid(stored)


def test_missing_total_is_zero_and_reported(worked):
    totals = C.atse_totals(worked[0]).filter("NOT (cell_id = 0 AND atse_id = 1)")
    obs = C.observed_entries(_dataset(worked, totals))
    assert obs.filter("n = 0").count() == 2
    with pytest.raises(ValueError, match="y_without_n"):
        C.assert_valid(obs)


def test_duplicate_entries_are_summed(spark, worked):
    counts, cells, junctions = worked
    twice = counts.unionAll(counts).drop("atse_id")
    layers = {JUNCTION_LAYER: twice, CLUSTER_LAYER: C.atse_totals(counts)}
    obs = C.observed_entries(Dataset(cells, junctions, layers))
    assert obs.agg({"y": "sum"}).first()[0] == 2 * np.sum(WORKED_Y)


@pytest.mark.parametrize(
    "present, missing",
    [({CLUSTER_LAYER}, JUNCTION_LAYER), ({JUNCTION_LAYER}, CLUSTER_LAYER), (set(), CLUSTER_LAYER)],
)
def test_missing_layers_are_named(worked, present, missing):
    full = _dataset(worked)
    data = Dataset(full.cells, full.junctions, {k: v for k, v in full.layers.items() if k in present})
    with pytest.raises(ValueError, match=missing):
        C.observed_entries(data)


def test_filter_is_strict_and_covers_both_layers(worked):
    counts, cells, junctions = worked
    kept, totals, mask = C.filter_junctions(counts, C.atse_totals(counts), cells, junctions, 2.0)
    assert sorted(r.junction_id for r in mask.filter("keep").collect()) == [1, 3, 4]
    assert {r.junction_id for r in kept.select("junction_id").distinct().collect()} == {1, 3, 4}
    assert totals.count() == 12


def test_sums_with_empty_keys(spark, worked):
    keys = spark.createDataFrame([(0,), (99,)], "cell_id long")
    sums = {r.cell_id: r.total for r in C.sum_by(worked[0], "cell_id", keys=keys).collect()}
    assert sums == {0: 8.0, 99: 0.0}


def test_sampling_ignores_partitioning(spark):
    cells = spark.range(1000).withColumnRenamed("id", "cell_id")
    one = sorted(r.cell_id for r in C.sample_cells(cells.repartition(7), 50, 1).collect())
    two = sorted(r.cell_id for r in C.sample_cells(cells.coalesce(1), 50, 1).collect())
    assert one == two and len(one) == 50
    assert one != sorted(r.cell_id for r in C.sample_cells(cells, 50, 2).collect())
    assert C.sample_cells(cells, 5000).count() == 1000


def test_lookup(spark):
    table = spark.createDataFrame([(1, "g1"), (2, "g2")], "junction_id long, gene_id string")
    assert C.lookup_one(table, 2, "gene_id") == "g2"
    with pytest.raises(KeyError):
        C.lookup_one(table, 3, "gene_id")


def test_labels(spark):
    df = spark.createDataFrame([("Myeloid_a_Myeloid_b",), ("oligodendrocyte_precursor_cell",), ("x",)], "t string")
    shown = [r.s for r in df.select(C.clean_label("t").alias("s")).collect()]
    assert shown == ["b", "oligodendrocyte_\nprecursor_cell", "x"]


def test_synthetic_data_is_valid(spark):
    counts, _, _ = tables(spark, *synthetic())
    C.assert_valid(C.with_totals(counts))


def test_one_hot_key_gives_the_same_totals(spark):
    """A third of all entries in one cell and one junction."""
    rng = np.random.default_rng(0)
    y = np.zeros((40, 40), dtype=int)
    y[0, :] = rng.integers(1, 5, 40)
    y[:, 0] = rng.integers(1, 5, 40)
    y[rng.random((40, 40)) < 0.1] = 1
    atse = np.arange(40) % 4
    counts, _, _ = tables(spark, y, atse)
    for r in C.with_totals(counts).collect():
        assert r.n == y[r.cell_id, atse == r.atse_id].sum()


def test_histogram(spark):
    values = np.random.default_rng(1).random(500)
    df = spark.createDataFrame([(0, float(v)) for v in values] + [(1, 2.0)], "g int, v double")
    rows = S.histogram(df, "v", ["g"], 10).orderBy("g", "bin").collect()
    counts, edges = np.histogram(values, 10)
    assert [r.n for r in rows[:10]] == counts.tolist()
    assert [r.left_edge for r in rows[:10]] == pytest.approx(edges[:-1])
    assert [r.n for r in rows[10:]] == np.histogram([2.0], 10)[0].tolist()


def test_histogram_moves_counts_only(spark):
    """The rows meet the written bounds where they are; only (group, bin) counts are shuffled."""
    df = spark.range(3000).selectExpr("id % 3 AS g", "id / 7 AS v")
    plan = S.histogram(df, "v", ["g"], 10)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    scan = next(k for k, line in enumerate(lines) if "Range (" in line)
    above = [line for line in lines[:scan] if "Exchange hashpartitioning" in line]
    # Two keys each: the group and the bin.
    assert above and all(line.split("hashpartitioning(")[1].count("#") == 2 for line in above) and "BroadcastHashJoin" in plan
