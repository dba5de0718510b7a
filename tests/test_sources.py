import gzip

import pytest
from data import WORKED_ATSE, WORKED_Y, tables

from countloom.operators import counts as C
from countloom.schema import CLUSTER_LAYER, JUNCTION_LAYER, Dataset
from countloom.sources import dataset as IO
from countloom.sources import gtf
from countloom.storage import checkpoint_root

LINES = [
    "# a comment",
    'chr1\tH\texon\t10\t20\t.\t+\t.\tgene_id "G1"; tag "x"; tag "y"; note "a b";',
    'chr1\tH\ttranscript\t1\t30\t.\t-\t.\ttag "z"',
    'chr2\tH\tgene\t5\t6\t0.5\t+\t0\tgene_id "G2";',
]


@pytest.fixture(params=["plain", "gzip"])
def gtf_path(request, tmp_path):
    text = "\n".join(LINES) + "\n"
    if request.param == "plain":
        path = tmp_path / "a.gtf"
        path.write_text(text)
    else:
        path = tmp_path / "a.gtf.gz"
        path.write_bytes(gzip.compress(text.encode()))
    return str(path)


def test_gtf(spark, gtf_path):
    rows = gtf.read_gtf(spark, gtf_path).orderBy("start").collect()
    assert [r.feature for r in rows] == ["transcript", "gene", "exon"]
    assert rows[2].attributes == {"gene_id": '"G1"', "tag": '"y"', "note": '"a b"'}
    assert (rows[2].start, rows[2].end, rows[1].score) == (10, 20, "0.5")
    stripped = gtf.read_gtf(spark, gtf_path, "exon", strip_quotes=True).first()
    assert stripped.attributes == {"gene_id": "G1", "tag": "y", "note": "a b"}


@pytest.mark.parametrize("kind, n", [("all", 3), ("exon", 1), ("transcript", 1), ("gene_id", 2), ("gene", 0)])
def test_gtf_filters(spark, gtf_path, kind, n):
    assert gtf.read_gtf(spark, gtf_path, kind).count() == n


def test_dataset_roundtrip_and_missing_layers(spark, tmp_path):
    counts, cells, junctions = tables(spark, WORKED_Y, WORKED_ATSE)
    layers = {JUNCTION_LAYER: counts.drop("atse_id"), CLUSTER_LAYER: C.atse_totals(counts)}
    IO.save_dataset(Dataset(cells, junctions, layers), f"{tmp_path}/full")
    obs = IO.load_observed(spark, f"{tmp_path}/full")
    assert obs.count() == 18 and obs.agg({"n": "max"}).first()[0] == 9
    for present, missing in ((JUNCTION_LAYER, CLUSTER_LAYER), (CLUSTER_LAYER, JUNCTION_LAYER)):
        IO.save_dataset(Dataset(cells, junctions, {present: layers[present]}), f"{tmp_path}/{present}")
        with pytest.raises(ValueError, match=missing):
            IO.load_dataset(spark, f"{tmp_path}/{present}")


def test_wrong_columns_are_named(spark, tmp_path):
    counts, cells, junctions = tables(spark, WORKED_Y, WORKED_ATSE)
    layers = {JUNCTION_LAYER: counts.drop("y"), CLUSTER_LAYER: C.atse_totals(counts)}
    IO.save_dataset(Dataset(cells, junctions, layers), str(tmp_path))
    with pytest.raises(ValueError, match="'y'"):
        IO.load_dataset(spark, str(tmp_path))


def test_initialisation_lookup(spark, tmp_path):
    psi = spark.createDataFrame([(3, 0, 1, 0.5)], "n_waypoints int, factor_idx int, junction_id long, psi double")
    phi = spark.createDataFrame([(3, 1, 0, 0.5)], "n_waypoints int, cell_id long, factor_idx int, phi double")
    IO.save_initialisation(psi, phi, str(tmp_path))
    assert IO.load_initialisation(spark, str(tmp_path), 3)[0].count() == 1
    with pytest.raises(ValueError, match="4 waypoints"):
        IO.load_initialisation(spark, str(tmp_path), 4)


def test_csv_has_header_and_no_index(spark, tmp_path):
    path = IO.save_results(spark.createDataFrame([(1, 2.5)], "a int, b double"), str(tmp_path))
    assert path.endswith("analysis_results.csv")
    rows = spark.read.option("header", True).csv(path).collect()
    assert [r.asDict() for r in rows] == [{"a": "1", "b": "2.5"}]


def test_checkpoint_folder_comes_from_the_session(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    if before:
        assert checkpoint_root(spark) == before
    else:
        assert checkpoint_root(spark)


def test_gtf_short_line(spark):
    lines = spark.createDataFrame([("# note",), ("",), ("chr1\tx\texon\t1\t2",)], "value string")
    with pytest.raises(Exception, match="fewer than 9 fields"):
        gtf.parse_gtf(lines).collect()
    assert gtf.parse_gtf(lines.limit(2)).count() == 0
