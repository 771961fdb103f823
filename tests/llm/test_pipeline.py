import pytest

import __spark_entry__ as entry
import corpus_pipeline
from seasonwin.llm.queries import ORACLES, QUERIES
from seasonwin.session import pin
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert "pipeline" in entry.queries() and QUERIES.keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(SF), SF, name)[1].startswith("ok")


def test_stages_on_odd_rows(spark):
    rows = [(1, None, "en", None, 0), (1, None, "en", None, 0), (2, "", None, "s", None), (None, "x y z", "en", "s", 5), (3, "a b c d e f\na b c d e f", "en", "t", 23)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        left = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = pin(stage(spark, left, SF), "stage")
            assert left.columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, left, SF)
        assert packed.count() == left.count()


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:3]:
        left = pin(stage(spark, docs, SF), "stage")
        assert {r.doc_id for r in left.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        counts.append(left.count())
        docs = left
    assert counts[0] > counts[1] > 0 and counts[1] >= counts[2] >= counts[3] > 0
