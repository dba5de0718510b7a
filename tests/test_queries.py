"""Every registered query against its SQL, and the rows of those without."""

import subprocess
import sys
from pathlib import Path

import pytest
from oracle import connect, difference

import __spark_entry__ as entry_points

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert df.count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_training_data_operators_are_optional():
    """Without the subpackage the rest registers all the same, whether the pipeline's file is there or not."""
    code = (
        "import importlib.util as u, sys\n"
        "find = u.find_spec\n"
        "u.find_spec = lambda name, *more: None if name == 'countloom.llm' else find(name, *more)\n"
        "sys.modules['countloom.llm'] = None\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 80 and not [q for q in e.queries() if q == 'pipeline' or q.startswith('op')]\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
