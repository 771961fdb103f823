"""Missing values in, missing values out; groups and series that a fit can't use."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonwin.functions import basis
from seasonwin.functions.columns import daylength
from seasonwin.operators import models, randomise, scan


def test_missing_inputs_have_no_value(spark):
    row = spark.createDataFrame([(None, None)], "d int, x double").select(
        daylength(46.0, "d"), basis.spline_basis("x", 0, 1, 5), basis.cyclic_basis("x", 0, 1, 5)
    ).first()
    assert list(row) == [None, None, None]


def test_a_missing_variable_has_no_effect(spark):
    data = spark.createDataFrame([(float(i % 50), float(i % 7)) for i in range(200)], "x double, y double")
    model = models.fit_additive(data, "y", [models.Smooth("x", 6)], lambdas=[0.1])
    both = data.limit(1).unionByName(spark.createDataFrame([(None, 1.0)], "x double, y double"))
    got = {r.x: (r.effect, r.se) for r in models.partial_residuals(both, model, "s(x)").collect()}
    assert got.pop(None) == (None, None) and None not in next(iter(got.values()))


def test_a_day_given_twice_counts_once(spark):
    rows = spark.createDataFrame([("v", "2020-01-01", 1.0), ("v", "2020-01-01", 2.0), ("v", "2020-01-02", 5.0)], "variable string, date string, value double")
    got = scan.complete_series(rows.withColumn("date", F.to_date("date"))).orderBy("date").collect()
    assert [r.value for r in got] == [1.5, 5.0]


def test_permutation_of_variables_that_cover_different_events(spark):
    """Every repeat's best criterion equals direct least squares on that variable's own shuffled responses."""
    drawn = np.random.default_rng(4)
    days = [np.datetime64("2000-01-01") + i for i in range(2200)]
    series = [(v, str(d), float(drawn.normal())) for v in ("a", "b") for i, d in enumerate(days) if v == "a" or i > 500]
    events = [(k, f"{2000 + k // 12}-{k % 12 + 1:02d}-01", float(drawn.normal())) for k in range(8, 48)]
    s = spark.createDataFrame(series, "variable string, date string, value double").withColumn("date", F.to_date("date"))
    e = spark.createDataFrame(events, "event_id long, bdate string, y double").withColumn("bdate", F.to_date("bdate"))
    got = randomise.randomise_scan(e, s, 3, 5, 6, 0, None, ["mean"], ["lin"]).collect()
    by_day = {(v, d): x for v, d, x in series}
    for r in got:
        own = [k for k in events if (r.variable, str(np.datetime64(k[1]) - 6)) in by_day]
        ids = [k[0] for k in own]
        y = {k[0]: k[2] for k in own}
        import hashlib

        order = lambda t: sorted(ids, key=lambda i: (hashlib.md5(f"5-{t}-{i}".encode()).hexdigest(), i))
        shuffled = dict(zip(order(0), (y[i] for i in order(r.repeat)), strict=True))
        z = np.array([shuffled[i] for i in ids])
        n, total, best = len(z), ((z - z.mean()) ** 2).sum(), np.inf
        aicc = lambda rss, k: n * (np.log(2 * np.pi * rss / n) + 1) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
        for a in range(7):
            for b in range(a + 1):
                x = np.array([np.mean([by_day[r.variable, str(np.datetime64(k[1]) - o)] for o in range(b, a + 1)]) for k in own])
                rss = total - ((x - x.mean()) @ (z - z.mean())) ** 2 / ((x - x.mean()) ** 2).sum()
                best = min(best, aicc(rss, 3) - aicc(total, 2))
        assert r.delta_aicc == pytest.approx(best, abs=1e-8)
    assert {(r.variable, r.repeat) for r in got} == {(v, t) for v in "ab" for t in (1, 2, 3)}
