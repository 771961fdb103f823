"""Ordered operators on the given tables.

Queries over raw rows pass a ``span``, since one key may hold most of the rows;
those over a daily series do not, since the calendar bounds it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seasonwin.functions.columns import season_year
from seasonwin.operators import ordered, rows
from seasonwin.plans.registry import query, r, rounded, table, to_date

_QUARTER = 92
_FOUR_HOURS = 4 * 3600


def dated_orders(spark, sf_dir):
    date = to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", date.alias("date"), season_year(date).alias("season"), "o_totalprice"
    )


def daily_priority(spark, sf_dir):
    """Daily count and mean log price per priority; some days lose their price."""
    daily = dated_orders(spark, sf_dir).groupBy("o_orderpriority", "season", "date").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.log("o_totalprice")).alias("price")
    )
    return daily.withColumn("price", F.when(F.dayofyear("date") % 50 != 0, F.col("price")))


_SEASON = "year(o_orderdate) + case when month(o_orderdate) >= 7 then 1 else 0 end"
_ORDERS = f"""o as (select o_orderkey, o_orderpriority, cast(o_orderdate as date) as d, {_SEASON} as season,
    o_totalprice from orders)"""
_DAILY = f"""{_ORDERS}, daily as (
  select o_orderpriority, season, d, count(*) as n,
    case when dayofyear(d) % 50 <> 0 then avg(ln(o_totalprice)) end as price from o group by 1, 2, 3)"""
_SPINE = f"""{_DAILY}, ends as (select o_orderpriority, min(d) as lo, max(d) as hi from daily group by 1),
  spine as (select o_orderpriority, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as d from ends),
  full_ as (
    select s.o_orderpriority, s.d,
      case when datediff('day', date '1970-01-01', s.d) % 20 not in (3, 8, 9, 13, 14, 15) then price end as price,
      case when datediff('day', date '1970-01-01', s.d) % 11 not in (4, 5) then n end as n,
      row_number() over (partition by s.o_orderpriority order by s.d) as rn
    from spine s left join daily using (o_orderpriority, d))"""


def _filled(c: str) -> str:
    """SQL for a linear fill of ``c`` by row number; the gap length is q - p - 1."""
    return f"""{c}_marks as (
    select *, max(case when {c} is not null then rn end) over (partition by o_orderpriority order by rn) as p,
      min(case when {c} is not null then rn end) over (partition by o_orderpriority order by rn
        rows between current row and unbounded following) as q from full_),
  {c}_fill as (
    select m.o_orderpriority, m.d, m.p, m.q, m.{c} as known,
      coalesce(m.{c}, a.{c} + (b.{c} - a.{c}) * (m.rn - m.p) / (m.q - m.p)) as {c}
    from {c}_marks m
    left join full_ a on a.o_orderpriority = m.o_orderpriority and a.rn = m.p
    left join full_ b on b.o_orderpriority = m.o_orderpriority and b.rn = m.q)"""


def gappy_calendar(spark, sf_dir):
    """A row per priority and day, with gaps of one to three days in the values."""
    daily = daily_priority(spark, sf_dir)
    spine = rows.date_spine(daily, ["o_orderpriority"], "date")
    full = spine.join(daily.drop("season"), ["o_orderpriority", "date"], "left")
    day = F.unix_date("date")
    return full.withColumns({
        "price": F.when(~(day % 20).isin(3, 8, 9, 13, 14, 15), F.col("price")),
        "n": F.when(~(day % 11).isin(4, 5), F.col("n")).cast("double"),
    })


@query(f"""with {_ORDERS} select o_orderkey,
    row_number() over (partition by o_orderpriority, season order by d, o_orderkey) as n_up,
    row_number() over (partition by o_orderpriority, season order by d desc, o_orderkey desc) as n_down from o""")
def count_up_down(spark, sf_dir):
    keys, order = ["o_orderpriority", "season"], ["date", "o_orderkey"]
    both = ordered.count_both(dated_orders(spark, sf_dir), keys, order, span=_QUARTER)
    return rounded(both.select("o_orderkey", "n_up", "n_down"))


@query(f"""with e as (select *, case when event_id % 97 <> 0 then value end as v, cast(ts as date) as d from events)
    select event_id, case when sum(case when v is null then 1 else 0 end) over w = 0 then {r('sum(v) over w', 2)} end
      as total
    from e window w as (partition by event_type, d order by ts, event_id
      rows between unbounded preceding and current row)""")
def running_sum_sticky(spark, sf_dir):
    known = F.when(F.col("event_id") % 97 != 0, F.col("value"))
    events = table(spark, sf_dir, "events").select(
        "event_id", "event_type", "ts", F.to_date("ts").alias("day"), known.alias("value")
    )
    total = ordered.running_sum(events, "value", ["event_type", "day"], ["ts", "event_id"], "total", span=_FOUR_HOURS)
    return rounded(total.select("event_id", "total"), 2)


@query(f"""with {_DAILY} select o_orderpriority, cast(d as varchar) as date,
    case when count(*) over w = count(price) over w then {r('sum(price) over w')} end as three_weeks
    from daily window w as (partition by o_orderpriority, season order by d rows between 20 preceding and current row)""")
def rolling_21_sum(spark, sf_dir):
    rolled = ordered.rolling_agg(
        daily_priority(spark, sf_dir), "price", 21, ["o_orderpriority", "season"], ["date"], "three_weeks"
    )
    return rounded(rolled.select("o_orderpriority", "date", "three_weeks"))


@query(f"""with {_ORDERS} select o_orderkey, {r('first_value(o_totalprice) over (partition by o_orderpriority, season order by d, o_orderkey)')} as first from o""")
def first_in_group(spark, sf_dir):
    first = ordered.first_in_group(
        dated_orders(spark, sf_dir), "o_totalprice", ["o_orderpriority", "season"], ["date", "o_orderkey"], "first"
    )
    return rounded(first.select("o_orderkey", "first"))


@query(f"""with {_DAILY}, numbered as (
    select *, row_number() over (partition by o_orderpriority, season order by d) as rn from daily),
  top as (select o_orderpriority, season, rn from (
    select *, row_number() over (partition by o_orderpriority, season order by n desc, rn) as k from numbered) where k = 1)
  select t.o_orderpriority, t.season, cast(d.d as varchar) as date, {r('b.price')} as "before"
  from top t join numbered d using (o_orderpriority, season)
  left join numbered b on b.o_orderpriority = t.o_orderpriority and b.season = t.season and b.rn = t.rn - 1""")
def value_before_peak(spark, sf_dir):
    before = ordered.value_before_peak(
        daily_priority(spark, sf_dir), "price", "n", ["o_orderpriority", "season"], ["date"], "before"
    )
    return rounded(before.select("o_orderpriority", "season", "date", "before"))


@query(f"""with {_SPINE}, {_filled('price')}
    select o_orderpriority, cast(d as varchar) as date, {r('price')} as price from price_fill""")
def interpolate_linear(spark, sf_dir):
    filled = ordered.interpolate_linear(gappy_calendar(spark, sf_dir), ["price"], ["o_orderpriority"], ["date"])
    return rounded(filled.select("o_orderpriority", "date", "price"))


@query(f"""with {_SPINE}, {_filled('price')}, {_filled('n')}
    select o_orderpriority, cast(d as varchar) as date,
      case when x.known is not null or x.q - x.p - 1 <= 2 then {r('x.price')} end as price,
      case when y.known is not null or y.q - y.p - 1 <= 2 then {r('y.n')} end as n
    from price_fill x join n_fill y using (o_orderpriority, d)""")
def interpolate_maxgap(spark, sf_dir):
    filled = ordered.interpolate_linear(
        gappy_calendar(spark, sf_dir), ["price", "n"], ["o_orderpriority"], ["date"], max_gap=2
    )
    return rounded(filled.select("o_orderpriority", "date", "price", "n"))


@query(f"""with {_SPINE} select o_orderpriority, cast(d as varchar) as date,
    {r('coalesce(price, avg(price) over (partition by o_orderpriority order by d rows between 2 preceding and 2 following))')}
      as price from full_""")
def fill_neighbours(spark, sf_dir):
    filled = ordered.fill_neighbours(gappy_calendar(spark, sf_dir), "price", ["o_orderpriority"], "date")
    return rounded(filled.select("o_orderpriority", "date", "price"))


@query(f"""with {_ORDERS} select o_orderkey,
    {r('dayofyear(d) - avg(dayofyear(d)) over (partition by o_orderpriority, season)')} as centered from o""")
def center_by_group(spark, sf_dir):
    days = dated_orders(spark, sf_dir).withColumn("doy", F.dayofyear("date"))
    centered = ordered.center(days, "doy", ["o_orderpriority", "season"], "centered")
    return rounded(centered.select("o_orderkey", "centered"))


@query(f"""with {_ORDERS} select o_orderpriority, season, o_orderkey, cast(d as varchar) as date, {r('o_totalprice')} as o_totalprice
    from (select *, row_number() over (partition by o_orderpriority, season order by o_totalprice desc, d, o_orderkey) as k
      from o) where k = 1""")
def argmax_rows(spark, sf_dir):
    ties = [-F.unix_date("date"), -F.col("o_orderkey")]
    return rounded(ordered.argmax_rows(dated_orders(spark, sf_dir), "o_totalprice", ["o_orderpriority", "season"], ties))
