import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from seasonwin.functions import columns as fn


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(n) for n, v in values.items()])
    return row.select(column.alias("out")).first()["out"]


def test_recode_compares_codes_as_text(spark):
    labels = {"Male": [1, "Male", "M"], "Female": [2, "F"]}
    df = spark.createDataFrame([("1",), ("M",), ("F",), ("2",), ("9",), (None,)], "c string")
    got = [r[0] for r in df.select(fn.recode("c", labels)).collect()]
    assert got == ["Male", "Male", "Female", "Female", None, None]


def test_hinge_keeps_missing_and_is_not_the_excess(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (5.0,), (7.0,), (None,)], "x double")
    assert [r[0] for r in df.select(fn.hinge("x")).collect()] == [0.0, 0.0, 5.0, 7.0, None]
    got = [r[0] for r in df.select(fn.hinge("x", 5.0, inclusive=True)).collect()]
    assert got == [0.0, 0.0, 5.0, 7.0, None]


def test_flags_are_missing_for_missing_values(spark):
    df = spark.createDataFrame([(2.0,), (0.0,), (None,)], "x double")
    assert [r[0] for r in df.select(fn.flag_positive("x")).collect()] == ["Open", "Ice", None]


def test_flag_between_pads_both_ends(spark):
    on, off = dt.date(2000, 1, 10), dt.date(2000, 2, 10)
    days = [dt.date(2000, 1, 8), dt.date(2000, 1, 9), on, off, dt.date(2000, 2, 11), dt.date(2000, 2, 12)]
    df = spark.createDataFrame([(d, on, off) for d in days] + [(on, None, off)], "d date, a date, b date")
    got = [r[0] for r in df.select(fn.flag_between("d", "a", "b", 1, 1)).collect()]
    assert got == ["open", "ice", "ice", "ice", "ice", "open", None]


def test_bucket_ranges_has_a_default_for_the_rest(spark):
    df = spark.createDataFrame([(1950,), (1958,), (1983,), (1984,), (2003,), (None,)], "y int")
    ranges = [(1958, 1983, "past"), (1984, 2002, "mid")]
    got = [r[0] for r in df.select(fn.bucket_ranges("y", ranges, "present")).collect()]
    assert got == ["present", "past", "past", "mid", "present", "present"]


def test_null_where_keeps_values_under_an_unknown_condition(spark):
    df = spark.createDataFrame([(5.0, 2006), (3.0, 2006), (5.0, 2005), (5.0, None)], "t double, y int")
    cond = (F.col("t") > 3.7) & (F.col("y") == 2006)
    assert [r[0] for r in df.select(fn.null_where("t", cond)).collect()] == [None, 3.0, 5.0, 5.0]


def test_season_year_and_day_of_year(spark):
    assert one(spark, fn.season_year(F.col("d")), d=dt.date(1999, 7, 1)) == 2000
    assert one(spark, fn.season_year(F.col("d")), d=dt.date(1999, 6, 30)) == 1999
    assert one(spark, fn.date_from_doy(F.col("y"), F.col("n")), y=2020, n=110) == dt.date(2020, 4, 19)


def test_bad_dates_are_missing(spark):
    df = spark.createDataFrame([("1/5/2001",), ("11/15/1955",), ("soon",), (None,)], "s string")
    got = [r[0] for r in df.select(fn.parse_date("s")).collect()]
    assert got == [dt.date(2001, 1, 5), dt.date(1955, 11, 15), None, None]


def test_log_ratio_needs_positive_sides(spark):
    df = spark.createDataFrame([(2.0, 1.0), (0.0, 1.0), (1.0, 0.0), (-1.0, 1.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(fn.log_ratio("a", "b")).collect()]
    assert got == [pytest.approx(math.log(2)), None, None, None, None]


def test_row_mean_skips_missing(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 3.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(fn.row_mean("a", "b")).collect()] == [2.0, 3.0, None]


def test_daylength_over_the_year(spark):
    df = spark.createDataFrame([(1,), (80,), (172,), (266,)], "doy int")
    got = [r[0] for r in df.select(fn.daylength(46.06413190, "doy")).collect()]
    assert got == pytest.approx([8.694, 12.149, 15.764, 12.195], abs=1e-3)


def test_prefer_observed_and_powers(spark):
    df = spark.createDataFrame([(2.0, 9.0), (0.0, 9.0), (None, 9.0)], "o double, p double")
    assert [r[0] for r in df.select(fn.prefer_observed("o", "p")).collect()] == [2.0, 9.0, None]
    assert tuple(df.select(*fn.power_terms("p", 3)).first()) == (9.0, 81.0, 729.0)
