import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonwin.operators import aggregate, joins, rows
from seasonwin.session import new_shared_path
from seasonwin.sources.tables import ICE_YEARS, plain_names, read_table, write_table


def test_csv_has_dates_gaps_and_quotes(spark):
    path = new_shared_path(spark, "t")
    data = [(1956, dt.date(1955, 11, 15), 1.5, 'a,"b"'), (1957, None, None, None)]
    write_table(spark.createDataFrame(data, "y int, d date, x double, s string"), path, "csv")
    back = read_table(spark, path, dict(y="int", d="date", x="double", s="string"))
    assert sorted(map(tuple, back.collect())) == data


def test_reader_turns_bad_values_into_missing(spark, tmp_path):
    (tmp_path / "ice.csv").write_text("Year,IceOn,IceOff,IceDuration\n1956,11/15/1955,4/30/1956,167\n1957,soon,NA,NA\n")
    got = read_table(spark, str(tmp_path / "ice.csv"), ICE_YEARS).collect()
    assert tuple(got[0]) == (1956, dt.date(1955, 11, 15), dt.date(1956, 4, 30), 167)
    assert tuple(got[1]) == (1957, None, None, None)


def test_reader_tab_and_nan(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\tb\tc\n1\tNaN\tNA\n2\t0.5\t\n")
    got = read_table(spark, str(tmp_path / "t.txt"), dict(a="int", b="double", c="string"), sep="\t").collect()
    assert [tuple(r) for r in got] == [(1, None, None), (2, 0.5, None)]


def test_uncount(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 3), ("d", None), ("e", 25_001)], "k string, n int")
    got = {r["k"]: r["count"] for r in rows.uncount(df, "n").groupBy("k").count().collect()}
    assert got == {"b": 1, "c": 3, "e": 25_001}


def test_near_group_mean_is_strict_and_uses_the_mean_before(spark):
    df = spark.createDataFrame([("a", 0), ("a", 10), ("a", 20), (None, 5), ("b", 7)], "k string, x int")
    got = sorted((r["k"] or "", r["x"]) for r in rows.filter_near_group_mean(df, ["k"], "x", 10).collect())
    assert got == [("", 5), ("a", 10), ("b", 7)]


def test_spines(spark):
    df = spark.createDataFrame([("a", 3), ("a", 5), ("b", 1)], "k string, x int")
    got = sorted(tuple(r) for r in rows.expand_seq(df, ["k"], F.min("x") - 1, F.max("x") + 1, "i").collect())
    assert got == [("a", i) for i in range(2, 7)] + [("b", i) for i in range(0, 3)]
    one = spark.createDataFrame([(0.0, 0.3)], "lo double, hi double")
    assert [r["x"] for r in rows.decimal_spine(one, "lo", "hi", 0.1, "x").collect()] == pytest.approx([0, 0.1, 0.2, 0.3])


def test_attach_matches_missing_keys(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, w int")
    got = {r["v"]: r["w"] for r in joins.attach(left, right, ["k"]).collect()}
    assert got == {1: 10, 2: 20, 3: None}


def test_attach_without_keys(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert {r["m"] for r in joins.attach_group(df, [], {"m": F.avg("x")}).collect()} == {2.0}


def test_fill_from_is_keyed_not_positional(spark):
    df = spark.createDataFrame([(2, None), (1, None), (3, 9.0), (4, None)], "d int, t double")
    lookup = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "day int, m double")
    got = {r["d"]: r["t"] for r in joins.fill_from(df, lookup, {"d": "day"}, {"t": "m"}).collect()}
    assert got == {1: 10.0, 2: 20.0, 3: 9.0, 4: None}


@pytest.mark.parametrize("keys", [["k"], []])
def test_interval_join_equals_brute_force(spark, keys):
    rng = np.random.default_rng(1)
    base = dt.date(2000, 1, 1)
    points = [(int(rng.integers(3)), base + dt.timedelta(int(d)), i) for i, d in enumerate(rng.integers(0, 400, 200))]
    spans = []
    for i in range(20):
        a = int(rng.integers(0, 350))
        spans.append((int(rng.integers(3)), base + dt.timedelta(a), base + dt.timedelta(a + int(rng.integers(0, 90))), i))
    p = spark.createDataFrame(points, "k int, d date, i int")
    s = spark.createDataFrame(spans, "k int, a date, b date, j int")
    if not keys:
        s = s.drop("k")
    got = sorted((r["i"], r["j"]) for r in joins.interval_join(p, s, keys, "d", "a", "b", pad=1).collect())
    one = dt.timedelta(1)
    want = sorted((i, j) for k, d, i in points for m, a, b, j in spans
                  if (k == m or not keys) and a - one <= d <= b + one)
    assert got == want


def test_quantiles_small_groups_ties_and_missing(spark):
    rng = np.random.default_rng(2)
    groups = {"a": [5.0], "b": [1.0, 2.0], "c": list(rng.normal(size=37)), "d": [3.0] * 9 + [4.0], None: [1.0, 9.0, 2.0]}
    data = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("c", None), ("e", None)]
    df = spark.createDataFrame(data, "k string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {(r["k"], r["prob"]): r["quantile"] for r in aggregate.quantiles(df, ["k"], "v", probs).collect()}
    want = {(k, p): np.quantile(vs, p) for k, vs in groups.items() for p in probs}
    assert got == pytest.approx(want)


def test_quantiles_of_a_large_group_use_the_bracket(spark):
    n = 120_000
    df = spark.range(n).select(
        F.lit("hot").alias("k"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pmod(F.hash("id"), F.lit(100_003)) / 7).alias("v")
    )
    values = np.array([r["v"] for r in df.collect()])
    got = {r["prob"]: r["quantile"] for r in aggregate.quantiles(df, ["k"], "v", [0.01, 0.5, 0.9]).collect()}
    assert got == pytest.approx({p: np.quantile(values, p) for p in (0.01, 0.5, 0.9)}, rel=1e-12)


def test_five_numbers_without_keys(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10)], "v double")
    got = aggregate.five_numbers(df, [], "v").first().asDict()
    assert got == {"min": 1.0, "q1": 2.0, "median": 3.0, "q3": 4.0, "mean": 4.0, "max": 10.0}


def test_quantiles_with_a_false_bracket_are_exact(spark, monkeypatch):
    """The first bracket lies beside the wanted ranks; counting shows that."""
    df = spark.range(60_000).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 60_013).cast("double").alias("v"))
    real = aggregate._bracket
    tried = []

    def false(prob, slack):
        tried.append(slack)
        return real(min(prob + 0.2, 1.0), slack) if slack < 0.01 else real(prob, slack)

    monkeypatch.setattr(aggregate, "_bracket", false)
    monkeypatch.setattr(aggregate, "_SKETCH_ACCURACY", 1000)
    got = {(r["k"], r["prob"]): r["quantile"] for r in aggregate.quantiles(df, ["k"], "v", [0.25, 0.5]).collect()}
    want = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("v", [0.25, 0.5]).alias("q")).collect()}
    assert len(set(tried)) > 1 and all(got[k, p] == pytest.approx(q[i]) for k, q in want.items() for i, p in enumerate((0.25, 0.5)))


def test_histogram_includes_the_upper_end_and_what_lies_outside(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.5, 1.0, 2.0, 2.1, -7.0, -8.0, None)], "v double")
    got = {r["bin"]: (r["n"], r["low"], r["high"]) for r in aggregate.histogram(df, "v", 0.0, 2.0, 2).collect()}
    assert got == {-1: (2, None, 0.0), 0: (2, 0.0, 1.0), 1: (2, 1.0, 2.0), 2: (1, 2.0, None)}


def test_daily_means_and_counts(spark):
    data = [("A", 1.0, 2.0, None), ("B", 3.0, None, 4.0), ("C", None, None, None)]
    df = spark.createDataFrame(data, "s string, p double, hi double, lo double").withColumn("d", F.lit(1))
    got = aggregate.daily_means(df, "d", dict(P="p", HI="hi", LO="lo"), {"MID": ("HI", "LO")}, ("N", "p")).first()
    assert got.asDict() == {"d": 1, "P": 2.0, "HI": 2.0, "LO": 4.0, "MID": 3.0, "N": 2}
    assert aggregate.coverage(df, ["d"], "p").first()["coverage"] == pytest.approx(2 / 3)


def test_mean_date_keeps_the_fraction(spark):
    df = spark.createDataFrame([(1, dt.date(2000, 1, 1)), (1, dt.date(2000, 1, 2))], "y int, d date")
    got = aggregate.mean_date(df, ["y"], "d").first()
    assert got["mean_date"] == dt.date(2000, 1, 1) and got["mean_day"] % 1 == 0.5


def test_weighted_mean(spark):
    df = spark.createDataFrame([(1.0, 1.0), (4.0, 3.0), (None, 5.0)], "v double, w double")
    assert df.agg(aggregate.weighted_mean("v", "w")).first()[0] == pytest.approx(13 / 4)


def test_partly_typed_and_inferred_reads(spark, tmp_path):
    path = tmp_path / "temps.csv"
    path.write_text("Date,Year,WaterTempC.AM,Notes\n1/2/2001,2001,NA,x\n3/4/2002,2002,4,NA\n")
    partly = read_table(spark, str(path), {"Date": "date", "WaterTempC.AM": "double"}, infer=True)
    assert dict(partly.dtypes) == {"Date": "date", "Year": "int", "WaterTempC.AM": "double", "Notes": "string"}
    rows = plain_names(partly).orderBy("Date").collect()
    assert [(str(r.Date), r.Year, r.WaterTempC_AM, r.Notes) for r in rows] == [("2001-01-02", 2001, None, "x"), ("2002-03-04", 2002, 4.0, None)]
    assert dict(read_table(spark, str(path), infer=True).dtypes)["Year"] == "int"
    with pytest.raises(ValueError, match="inferred"):
        read_table(spark, str(path))
    with pytest.raises(ValueError, match="no such"):
        read_table(spark, str(path), {"Nothing": "int"}, infer=True)


def test_writing_again_replaces(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in (3, 2):
        write_table(spark.range(n), path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception, match="already exists"):
        write_table(spark.range(1), path, mode="errorifexists")
