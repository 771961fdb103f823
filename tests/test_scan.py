import datetime as dt
import math

import numpy as np
import pytest

from seasonwin.operators import products, randomise, scan
from seasonwin.operators.joins import relative_series

START, STOP, EXCLUDE = 12, -4, (3, -4)
FIRST = dt.date(1990, 1, 1)


def days(n):
    return FIRST + dt.timedelta(n)


def make(spark, years=25, gap=40, seed=5, missing=()):
    """A noise series around 1000 and one event every ``gap`` days."""
    rng = np.random.default_rng(seed)
    length = years * gap + 60
    values = 1000 + rng.normal(size=length)
    series = spark.createDataFrame(
        [("a", days(i), float(v)) for i, v in enumerate(values) if i not in missing],
        "variable string, date date, value double",
    )
    at = [30 + i * gap + int(rng.integers(0, 5)) for i in range(years)]
    y = rng.normal(size=years)
    events = spark.createDataFrame(
        [(i, days(a), float(v), "odd" if i % 2 else "even") for i, (a, v) in enumerate(zip(at, y))],
        "event_id int, bdate date, y double, g string",
    )
    return events, series, values, np.array(at), y


def windows(start=START, stop=STOP, exclude=EXCLUDE):
    for o in range(stop, start + 1):
        for c in range(stop, o + 1):
            if exclude is None or not (o - c + 1 <= exclude[0] and c >= exclude[1]):
                yield o, c


def stat_of(values, at, o, c, stat):
    out = []
    for a in at:
        part = values[a - o: a - c + 1]
        out.append(part.mean() if stat == "mean" else np.polyfit(np.arange(len(part)), part, 1)[0])
    return np.array(out)


def criteria(x, y, degree):
    design = np.vander(x - x.mean(), degree + 1, increasing=True)
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    rss = ((y - design @ beta) ** 2).sum()

    def aicc(rss, k, n=len(y)):
        return n * (math.log(2 * math.pi * rss / n) + 1) + 2 * k + 2 * k * (k + 1) / (n - k - 1)

    return rss, aicc(rss, degree + 2) - aicc(((y - y.mean()) ** 2).sum(), 2)


def test_window_counts(spark):
    one = spark.range(1)
    assert scan.enumerate_windows(one, 120, -150, None).count() == 36_856
    assert scan.enumerate_windows(one, 120, -150).count() == 34_191
    assert scan.enumerate_windows(one, 120, -150, (9, -150)).count() == 34_453


@pytest.mark.parametrize("per_chunk", [1024, 4])
def test_scan_equals_a_direct_fit_of_every_window(spark, monkeypatch, per_chunk):
    monkeypatch.setattr(products, "_EVENTS_AT_A_TIME", per_chunk)
    events, series, values, at, y = make(spark)
    got = {
        (r["stat"], r["func"], r["open"], r["close"]): r
        for r in scan.scan_windows(events, scan.complete_series(series), START, STOP, EXCLUDE).collect()
    }
    assert len(got) == 4 * len(list(windows()))
    for o, c in windows():
        for stat in ("mean", "slope"):
            x = stat_of(values, at, o, c, stat)
            for func, degree in (("lin", 1), ("quad", 2)):
                r = got[stat, func, o, c]
                rss, delta = criteria(x, y, degree)
                assert r["rss"] == pytest.approx(rss, rel=1e-6)
                assert r["delta_aicc"] == pytest.approx(delta, abs=1e-5)
                fit = r["b0"] + r["b1"] * x + (r["b2"] or 0.0) * x * x
                assert ((y - fit) ** 2).sum() == pytest.approx(rss, rel=1e-4)
    for stat in ("mean", "slope"):
        for func in ("lin", "quad"):
            part = [r for k, r in got.items() if k[:2] == (stat, func)]
            assert sum(r["weight"] for r in part) == pytest.approx(1.0)
            best = min(part, key=lambda r: r["delta_aicc"])
            assert best["rank"] == 1


def test_groups_are_fitted_apart(spark):
    events, series, values, at, y = make(spark)
    full = scan.complete_series(series)
    both = scan.scan_windows(events, full, START, STOP, EXCLUDE, ["mean"], ["lin"], group=["g"])
    odd = scan.scan_windows(events.where("g = 'odd'"), full, START, STOP, EXCLUDE, ["mean"], ["lin"])
    a = {(r["open"], r["close"]): (r["rank"], round(r["delta_aicc"], 9)) for r in both.where("g = 'odd'").collect()}
    b = {(r["open"], r["close"]): (r["rank"], round(r["delta_aicc"], 9)) for r in odd.collect()}
    assert a == b


def test_planted_window_is_found(spark):
    rng = np.random.default_rng(8)
    values = rng.normal(size=61 * 365)
    at = [400 + 365 * i for i in range(58)]
    y = [2 * values[a - 40: a - 20 + 1].mean() + rng.normal(scale=0.1) for a in at]
    series = spark.createDataFrame([("a", days(i), float(v)) for i, v in enumerate(values)],
                                   "variable string, date date, value double")
    events = spark.createDataFrame([(i, days(a), float(v)) for i, (a, v) in enumerate(zip(at, y))],
                                   "event_id int, bdate date, y double")
    args = (60, 0, (10, 0), ["mean"], ["lin"])
    fits = scan.scan_windows(events, series, *args).cache()
    best = fits.where("rank = 1").first()
    assert abs(best["open"] - 40) <= 3 and abs(best["close"] - 20) <= 3
    assert best["b1"] == pytest.approx(2.0, abs=0.3)
    rand = randomise.randomise_scan(events, series, 20, 1, *args)
    p = randomise.permutation_p(fits, rand).first()
    assert p["p"] == 0.0 and p["p_text"] == "<0.001" and p["repeats"] == 20
    chosen = scan.confidence_set(fits).collect()
    weights = sorted((r["weight"] for r in fits.collect()), reverse=True)
    assert len(chosen) == int(np.searchsorted(np.cumsum(weights), 0.95)) + 1


def test_a_constant_series_gives_no_model(spark):
    events, _, _, _, _ = make(spark)
    flat = spark.createDataFrame([("a", days(i), 3.0) for i in range(1200)], "variable string, date date, value double")
    got = scan.scan_windows(events, flat, START, STOP, EXCLUDE, ["mean"]).collect()
    assert got and all(r["b1"] is None and r["delta_aicc"] is None for r in got)


def test_missing_days_are_filled(spark):
    _, series, values, _, _ = make(spark, missing={50, 70, 71, 72, 73, 74, 75, 76})
    got = {r["date"]: r["value"] for r in scan.complete_series(series).collect()}
    assert got[days(50)] == pytest.approx(np.mean([values[i] for i in (48, 49, 51, 52)]))
    assert got[days(70)] == pytest.approx(np.mean([values[i] for i in (68, 69)]))
    low, high = got[days(71)], got[days(75)]
    assert got[days(73)] == pytest.approx((low + high) / 2)
    assert len(got) == len(values)
    with pytest.raises(Exception, match="no value near"):
        scan.complete_series(series, on_gap="error").collect()


def test_events_outside_the_series_drop_out(spark):
    events, series, values, at, y = make(spark)
    early = spark.createDataFrame([(99, days(5), 1.0, "x"), (98, days(len(values)), 1.0, "x")], events.schema)
    rel = relative_series(events.unionByName(early), scan.complete_series(series), START, STOP)
    got = {(r["event_id"], r["offset"]): r["value"] for r in rel.collect()}
    assert len(got) == len(at) * (START - STOP + 1)
    assert got[3, 12] == pytest.approx(values[at[3] - 12]) and got[3, -4] == pytest.approx(values[at[3] + 4])


def test_shuffle_keeps_the_responses(spark):
    events, *_, y = make(spark)
    got = randomise.shuffled_responses(events, 5, 1).collect()
    assert len(got) == len(y) and sorted(r["position"] for r in got) == list(range(1, len(y) + 1))
    for i in range(5):
        column = [r["ys"][i] for r in got]
        assert sorted(column) == pytest.approx(sorted(y)) and column != [y[r["event_id"]] for r in got]


@pytest.mark.parametrize("per_task", [1024, 8])
def test_randomise_equals_scans_of_the_shuffled_events(spark, monkeypatch, per_task):
    monkeypatch.setattr(products, "_EVENTS_AT_A_TIME", per_task)
    events, series, values, at, y = make(spark, years=20)
    got = randomise.randomise_scan(events, series, 3, 9, START, STOP, EXCLUDE).collect()
    assert len(got) == 3 * 4
    ys = {r["event_id"]: r["ys"] for r in randomise.shuffled_responses(events, 3, 9).collect()}
    for r in got:
        shuffled = np.array([ys[i][r["repeat"] - 1] for i in range(len(at))])
        degree = 1 if r["func"] == "lin" else 2
        deltas = {
            w: criteria(stat_of(values, at, *w, r["stat"]), shuffled, degree)[1] for w in windows()
        }
        assert r["delta_aicc"] == pytest.approx(min(deltas.values()), abs=1e-5)
        assert deltas[r["open"], r["close"]] == pytest.approx(min(deltas.values()), abs=1e-5)


def test_curve_interval_equals_matrix_algebra(spark):
    events, series, values, at, y = make(spark)
    full = scan.complete_series(series)
    fits = scan.scan_windows(events, full, START, STOP, EXCLUDE, ["mean"], ["quad"]).cache()
    data = scan.best_model_data(fits, events, full, START, STOP).cache()
    best = fits.where("rank = 1").first()
    x = stat_of(values, at, best["open"], best["close"], "mean")
    design = np.vander(x - x.mean(), 3, increasing=True)
    cov = np.linalg.inv(design.T @ design) * best["rss"] / (len(y) - 3)
    for r in scan.predict_curve(data, fits).collect():
        row = np.vander([r["climate"] - x.mean()], 3, increasing=True)[0]
        assert r["se"] == pytest.approx(math.sqrt(row @ cov @ row), rel=1e-4)
        assert r["UCI"] - r["LCI"] == pytest.approx(2 * 1.96 * r["se"])


def test_baseline(spark):
    events, *_, y = make(spark)
    got = scan.fit_baseline(events).first()
    assert got["n"] == len(y) and got["mean_y"] == pytest.approx(y.mean())
    assert got["rss"] == pytest.approx(((y - y.mean()) ** 2).sum())
    average = scan.average_models(scan.confidence_set(spark.createDataFrame(
        [("a", "mean", "quad", 5, 1, 1, 0.9, 1.0, 2.0, 3.0), ("a", "mean", "quad", 9, 3, 2, 0.1, 2.0, 4.0, 6.0)],
        "variable string, stat string, func string, open int, close int, rank int, weight double, b0 double, b1 double, b2 double",
    ))).first()
    assert average["b1"] == pytest.approx(2.2) and average["median_open"] == 7.0
