"""The pipeline's stages on odd documents: each keeps what it must and returns documents."""

from pathlib import Path

import pytest

import corpus_pipeline
from countloom.llm.tables import DOCUMENT_COLUMNS

from . import brute

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def test_stages_follow_each_other(spark):
    rows = brute.odd_rows()
    docs = brute.frame(spark, rows)
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == DOCUMENT_COLUMNS, name
        docs = spark.createDataFrame(docs.collect(), brute.SCHEMA)
        seen.append(docs.count())
    ids, sets = brute.components(rows)
    good = [k for k, r in enumerate(rows) if len(brute.words(r[1])) >= 10 and 100 * brute.repeat_words(r[1]) <= 20 * len(brute.words(r[1]))]
    assert seen[1] == len(good)
    part = [rows[k] for k in good]
    ids, _ = brute.components(part)
    assert seen[2] == len({(r[0], r[1]) for r, c in zip(part, ids) if r[0] == c})
    packed = corpus_pipeline.best_fit_packing(spark, docs, SF_DIR)
    assert sum(r.length for r in packed.collect()) == sum(len(brute.words(r.text)) for r in docs.collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
