import pytest

import __spark_entry__ as entry
from seasonwin.plans.registry import ORACLES, QUERIES
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"
#: Scans of the whole range take some seconds each; one of each kind is compared here, all of them by tools/compare.py.
SCANS = ["scan_quad_mean", "confidence_set", "best_model_data", "randomise_scan", "baseline_fit"]


def test_every_sql_belongs_to_a_query():
    entry.queries()
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) >= 76


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def compared():
    entry.queries()
    return sorted(n for n in ORACLES if QUERIES[n].__module__ != "seasonwin.plans.scan_queries" or n in SCANS)


@pytest.mark.parametrize("name", compared())
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, SF, name)[1].startswith("ok")
