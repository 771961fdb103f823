import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonwin.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; days repeat, ids break the ties; some values are missing."""
    rng = np.random.default_rng(3)
    data = []
    for i in range(600):
        key = "hot" if i % 4 else ("cold" if i % 8 else None)
        day = dt.date(2001, 1, 1) + dt.timedelta(int(rng.integers(0, 60)))
        value = None if rng.random() < 0.1 else round(float(rng.normal()), 3)
        data.append((key, day, i, value))
    return spark.createDataFrame(data, "k string, d date, id int, v double").cache()


def by_id(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for i in a:
        for x, y in zip(a[i], b[i]):
            assert (x is None) == (y is None), i
            assert x is None or x == pytest.approx(y, abs=1e-9), i


def test_counters_agree_with_and_without_span(skewed):
    order = ["d", "id"]
    plain = ordered.count_down(ordered.count_up(skewed, ["k"], order), ["k"], order)
    spans = ordered.count_down(ordered.count_up(skewed, ["k"], order, span=7), ["k"], order, span=7)
    same(by_id(plain, "n_up", "n_down"), by_id(spans, "n_up", "n_down"))
    sizes = {r["k"]: r["count"] for r in skewed.groupBy("k").count().collect()}
    assert all(r["n_up"] + r["n_down"] == sizes[r["k"]] + 1 for r in plain.collect())


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("span", [None, 7])
def test_no_frame_is_added_up_anew_for_every_row(skewed, span):
    # Frames that begin at a row and end with the partition take the square of its rows.
    order = ["d", "id"]
    for df in (
        ordered.count_both(skewed, ["k"], order, span=span),
        ordered.count_down(skewed, ["k"], order, span=span),
        ordered.interpolate_linear(skewed, ["v"], ["k"], order, span=span),
    ):
        plan = plan_of(df)
        assert "specifiedwindowframe(RowFrame, unboundedpreceding$(), currentrow$())" in plan
        assert "currentrow$(), unboundedfollowing$()" not in plan and "1, unboundedfollowing$()" not in plan


@pytest.mark.parametrize("span", [None, 7])
def test_backward_aggregates_mirror_the_forward_order(spark, span):
    days = [None, None, 1, 1, 1, 9, 9, 20, 20, 40]
    data = [(k, d, None if i % 4 == 1 else (i * 7) % 10) for k in ("a", None) for i, d in enumerate(days)]
    df = spark.createDataFrame(data, "k string, d int, v bigint")
    one = (F.lit(1).cast("long"), F.sum)
    got = ordered.running(
        df, ["k"], ["d", "v"], {"up": one, "low": (F.col("v"), F.min)},
        {"down": one, "rest": (F.col("v"), F.sum), "real": (F.col("v").cast("double"), F.sum), "top": (F.col("v"), F.max)},
        ordered._chunk(df, ["d"], span),
    ).collect()
    for k in ("a", None):
        rows = sorted((r for r in got if r["k"] == k), key=lambda r: r["up"])
        want = sorted((x[1:] for x in data if x[0] == k), key=lambda x: [(y is not None, y or 0) for y in x])
        assert [(r["d"], r["v"]) for r in rows] == want
        assert [(r["up"], r["down"]) for r in rows] == [(i + 1, len(want) - i) for i in range(len(want))]
        for i, r in enumerate(rows):
            before, after = ([v for _, v in part if v is not None] for part in (want[: i + 1], want[i:]))
            assert r["low"] == min(before, default=None) and r["top"] == max(after, default=None)
            assert r["rest"] == r["real"] == (sum(after) if after else None)


@pytest.mark.parametrize("span", [None, 7])
def test_counters_of_equal_rows_add_up(spark, span):
    df = spark.createDataFrame([("a", 3)] * 40 + [("a", 1)] * 30 + [("a", 30), ("b", 3)], "k string, d int").repartition(5)
    got = ordered.count_both(df, ["k"], ["d"], span=span).collect()
    assert sorted(r["n_up"] for r in got if r["k"] == "a") == list(range(1, 72))
    assert all(r["n_up"] + r["n_down"] == (72 if r["k"] == "a" else 2) for r in got)


@pytest.mark.parametrize("sticky", [True, False])
def test_running_sum(skewed, sticky):
    args = ("v", ["k"], ["d", "id"], "s", sticky)
    same(by_id(ordered.running_sum(skewed, *args), "s"), by_id(ordered.running_sum(skewed, *args, span=5), "s"))


def test_running_sum_sticks_at_the_first_gap(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 4.0)], "id int, v double")
    assert [r["s"] for r in ordered.running_sum(df, "v", [], ["id"], "s").orderBy("id").collect()] == [1.0, 3.0, None, None]


def test_rolling_rows(skewed):
    args = ("v", 21, ["k"], ["d", "id"], "s")
    plain = by_id(ordered.rolling_agg(skewed, *args, sticky=False), "s")
    same(plain, by_id(ordered.rolling_agg(skewed, *args, sticky=False, span=5, rows_per_chunk=30), "s"))
    # Chunks shorter than the frame grow to its size.
    same(plain, by_id(ordered.rolling_agg(skewed, *args, sticky=False, span=5, rows_per_chunk=1), "s"))


def test_rolling_is_partial_and_sticky(spark):
    df = spark.createDataFrame([(i, None if i == 3 else float(i)) for i in range(1, 7)], "id int, v double")
    got = [r["s"] for r in ordered.rolling_agg(df, "v", 2, [], ["id"], "s").orderBy("id").collect()]
    assert got == [1.0, 3.0, None, None, 9.0, 11.0]
    top = [r["s"] for r in ordered.rolling_agg(df, "v", 2, [], ["id"], "s", fn=F.max, sticky=False).orderBy("id").collect()]
    assert top == [1.0, 2.0, 2.0, 4.0, 5.0, 6.0]


def test_interpolation_rules(spark):
    values = [None, 1.0, None, 3.0, None, None, 6.0, None, None, None, 10.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    free = [r["v"] for r in ordered.interpolate_linear(df, ["v"], [], ["id"]).orderBy("id").collect()]
    assert free == [None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, None]
    short = [r["v"] for r in ordered.interpolate_linear(df, ["v"], [], ["id"], max_gap=2).orderBy("id").collect()]
    assert short == [None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, None, None, None, 10.0, None]


def test_interpolation_by_position_or_by_date(spark):
    days = [dt.date(2000, 1, 1), dt.date(2000, 1, 2), dt.date(2000, 1, 11)]
    df = spark.createDataFrame(list(zip(days, [0.0, None, 10.0])), "d date, v double")
    rows_ = [r["v"] for r in ordered.interpolate_linear(df, ["v"], [], ["d"]).orderBy("d").collect()]
    dates = [r["v"] for r in ordered.interpolate_linear(df, ["v"], [], ["d"], x="d").orderBy("d").collect()]
    assert rows_ == [0.0, 5.0, 10.0] and dates == [0.0, 1.0, 10.0]


def test_interpolation_agrees_with_span(skewed):
    plain = ordered.interpolate_linear(skewed, ["v"], ["k"], ["d", "id"], max_gap=2)
    spans = ordered.interpolate_linear(skewed, ["v"], ["k"], ["d", "id"], max_gap=2, span=3)
    same(by_id(plain, "v"), by_id(spans, "v"))


def test_timestamp_and_number_spans(spark):
    base = dt.datetime(2024, 1, 1)
    data = [(i, base + dt.timedelta(minutes=7 * i), float(i)) for i in range(100)]
    df = spark.createDataFrame(data, "id int, t timestamp_ntz, v double")
    want = {i: (float(i * (i + 1) / 2),) for i in range(100)}
    same(by_id(ordered.running_sum(df, "v", [], ["t"], "s", span=3600), "s"), want)
    same(by_id(ordered.running_sum(df, "v", [], ["id"], "s", span=9), "s"), want)


def test_value_before_peak_takes_the_first_of_ties(spark):
    data = [("a", 1, 0, 5.0), ("a", 2, 3, 6.0), ("a", 3, 3, 7.0), ("b", 1, 9, 1.0), ("b", 2, 1, 2.0)]
    df = spark.createDataFrame(data, "k string, id int, p int, v double")
    got = {(r["k"], r["id"]): r["o"] for r in ordered.value_before_peak(df, "v", "p", ["k"], ["id"], "o").collect()}
    assert got == {("a", 1): 5.0, ("a", 2): 5.0, ("a", 3): 5.0, ("b", 1): None, ("b", 2): None}


def test_first_center_argmax(spark):
    data = [("a", 2, 4.0), ("a", 1, None), ("b", 1, 1.0), ("b", 2, 3.0), ("b", 3, 3.0)]
    df = spark.createDataFrame(data, "k string, id int, v double")
    first = {(r["k"], r["id"]): r["f"] for r in ordered.first_in_group(df, "v", ["k"], ["id"], "f").collect()}
    assert first == {("a", 1): None, ("a", 2): None, ("b", 1): 1.0, ("b", 2): 1.0, ("b", 3): 1.0}
    centered = {(r["k"], r["id"]): r["c"] for r in ordered.center(df, "v", ["k"], "c").collect()}
    assert centered[("b", 1)] == pytest.approx(1 - 7 / 3) and centered[("a", 1)] is None
    best = {r["k"]: r["id"] for r in ordered.argmax_rows(df, "v", ["k"], [-F.col("id")]).collect()}
    assert best == {"a": 2, "b": 2}


def test_fill_neighbours_uses_calendar_days(spark):
    data = [(dt.date(2000, 1, d), v) for d, v in [(1, 1.0), (2, None), (3, 5.0), (9, None), (12, 3.0)]]
    df = spark.createDataFrame(data, "d date, v double")
    got = [r["v"] for r in ordered.fill_neighbours(df, "v", [], "d").orderBy("d").collect()]
    assert got == [1.0, 3.0, 5.0, None, 3.0]
