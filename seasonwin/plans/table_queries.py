"""Projections, filters, joins and aggregates on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seasonwin.functions import columns as fn
from seasonwin.operators import aggregate, joins, rows
from seasonwin.plans.registry import query, r, rounded, table, to_date
from seasonwin.session import new_shared_path
from seasonwin.sources.tables import read_table, write_table

LATITUDE = 46.06413190


def events_with_gaps(spark, sf_dir):
    """Events with every seventh value missing."""
    known = F.col("event_id") % 7 != 0
    return table(spark, sf_dir, "events").withColumn("value", F.when(known, F.col("value")))


_GAPS = "gaps as (select *, case when event_id % 7 <> 0 then value end as v from events)"


# ----------------------------------------------------------------- sources


@query(f"""select o_orderkey, cast(cast(o_orderdate as date) as varchar) as "Date",
    case when o_orderkey % 9 <> 0 then {r('o_totalprice')} end as price, o_orderpriority from orders""")
def src_csv_roundtrip(spark, sf_dir):
    source = table(spark, sf_dir, "orders").select(
        "o_orderkey", to_date("o_orderdate").alias("Date"),
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("price"), "o_orderpriority",
    )
    path = new_shared_path(spark, "csv")
    write_table(source, path, "csv")
    schema = dict(o_orderkey="bigint", Date="date", price="double", o_orderpriority="string")
    return rounded(read_table(spark, path, schema))


# ------------------------------------------------- projections and filters


@query("""select label, count(*) as n from (
    select case when code in ('1', 'Male', 'A') then 'Male' when code in ('2', 'Female', 'N', 'F') then 'Female'
      when code in ('3', 'Unknown', 'U') then 'Unknown' end as label
    from (select case when l_linenumber <= 4 then cast(l_linenumber as varchar) else l_returnflag end as code
      from lineitem)) group by 1""")
def recode_labels(spark, sf_dir):
    line = F.col("l_linenumber")
    code = F.when(line <= 4, line.cast("string")).otherwise(F.col("l_returnflag"))
    labels = {"Male": [1, "Male", "A"], "Female": [2, "Female", "N", "F"], "Unknown": [3, "Unknown", "U"]}
    labelled = table(spark, sf_dir, "lineitem").select(fn.recode(code, labels).alias("label"))
    return aggregate.row_counts(labelled, ["label"])


@query(f"""select l_orderkey, sum(l_linenumber - 1) as n, {r('sum((l_linenumber - 1) * l_quantity)', 2)} as quantity
    from lineitem where l_linenumber > 1 group by 1""")
def uncount_rows(spark, sf_dir):
    counted = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", (F.col("l_linenumber") - 1).alias("count")
    )
    copies = rows.uncount(counted, "count").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )
    return rounded(copies, 2)


@query("""select year, o_orderpriority, count(*) as n, min(doy) as first, max(doy) as last from (
    select *, avg(doy) over (partition by year, o_orderpriority) as m from (
      select year(o_orderdate) as year, o_orderpriority, dayofyear(o_orderdate) as doy from orders))
    where abs(m - doy) < 60 group by 1, 2""")
def near_group_mean(spark, sf_dir):
    date = to_date("o_orderdate")
    days = table(spark, sf_dir, "orders").select(
        F.year(date).alias("year"), "o_orderpriority", fn.day_of_year(date).alias("doy")
    )
    keys = ["year", "o_orderpriority"]
    near = rows.filter_near_group_mean(days, keys, "doy", 60)
    return rounded(near.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("doy").alias("first"), F.max("doy").alias("last")
    ))


@query(f"""with {_GAPS}
    select event_type, count(t) as n, {r('sum(case when t > 0 then t when t <= 0 then 0 end)', 3)} as gdd0,
      {r('sum(case when t >= 5 then t when t < 5 then 0 end)', 3)} as gdd5
    from (select event_type, v - 50 as t from gaps) group by 1""")
def hinge_degree_days(spark, sf_dir):
    t = events_with_gaps(spark, sf_dir).select("event_type", (F.col("value") - 50).alias("t"))
    hinged = t.withColumns({"gdd0": fn.hinge("t"), "gdd5": fn.hinge("t", 5.0, inclusive=True)})
    return rounded(hinged.groupBy("event_type").agg(
        F.count("gdd0").alias("n"), F.sum("gdd0").alias("gdd0"), F.sum("gdd5").alias("gdd5")
    ), 3)


@query("""select case when y between 1995 and 1996 then 'past' when y between 1997 and 1998 then 'mid'
      else 'present' end as period, count(*) as n
    from (select year(o_orderdate) as y from orders) group by 1""")
def bucket_periods(spark, sf_dir):
    year = F.year(to_date("o_orderdate"))
    ranges = [(1995, 1996, "past"), (1997, 1998, "mid")]
    period = fn.bucket_ranges(year, ranges, "present").alias("period")
    return aggregate.row_counts(table(spark, sf_dir, "orders").select(period), ["period"])


@query(f"""select year(o_orderdate) + case when month(o_orderdate) >= 7 then 1 else 0 end as season, count(*) as n,
      {r('sum(o_totalprice)', 1)} as total from orders group by 1""")
def season_year_totals(spark, sf_dir):
    season = fn.season_year(to_date("o_orderdate")).alias("season")
    return rounded(table(spark, sf_dir, "orders").groupBy(season).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")
    ), 1)


@query(f"""with {_GAPS}
    select event_type, count(w) as n, {r('max(w)')} as highest, {r('sum(w)', 2)} as total
    from (select event_type, case when v > 200 and event_type = 'click' then null else v end as w from gaps)
    group by 1""")
def null_where_spurious(spark, sf_dir):
    spurious = (F.col("value") > 200) & (F.col("event_type") == "click")
    kept = events_with_gaps(spark, sf_dir).select("event_type", fn.null_where("value", spurious).alias("w"))
    return rounded(kept.groupBy("event_type").agg(
        F.count("w").alias("n"), F.max("w").alias("highest"), F.sum("w").alias("total")
    ), total=2)


@query(f"""select p_partkey, {r('case when p_partkey % 7 = 0 then floor(p_retailprice / 10) * 10 else p_retailprice end')}
    as length from part""")
def coalesce_length(spark, sf_dir):
    price = F.col("p_retailprice")
    length = F.when(F.col("p_partkey") % 7 != 0, price)
    bin_ = (F.floor(price / 10) * 10).cast("double")
    return rounded(table(spark, sf_dir, "part").select("p_partkey", F.coalesce(length, bin_).alias("length")))


@query("""select o_orderkey, cast(cast(o_orderdate as date) as varchar) as "OrderDate",
    case when o_orderkey % 11 <> 0 then cast(cast(o_orderdate as date) + 10 as varchar) end as "DueDate" from orders""")
def parse_dates_suffix(spark, sf_dir):
    def text(d):
        return F.concat_ws("/", F.month(d), F.day(d), F.year(d))

    date = to_date("o_orderdate")
    written = table(spark, sf_dir, "orders").select(
        "o_orderkey", text(date).alias("OrderDate"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit("not known")).otherwise(text(F.date_add(date, 10))).alias("DueDate"),
    )
    return rounded(rows.parse_dates(written, suffix="Date"))


@query("""select state, sign, count(*) as n from (
    select case when cast(l_shipdate as date) between cast(o_orderdate as date) + 29 and cast(o_orderdate as date) + 91
        then 'ice' else 'open' end as state,
      case when l_discount > 0 then 'Open' else 'Ice' end as sign
    from lineitem join orders on l_orderkey = o_orderkey) group by 1, 2""")
def flag_between_dates(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", to_date("l_shipdate").alias("ship"), "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", to_date("o_orderdate").alias("ordered"))
    joined = joins.join_on(lines, orders, {"l_orderkey": "o_orderkey"}).withColumns({
        "on": F.date_add("ordered", 30), "off": F.date_add("ordered", 90),
    })
    flags = joined.select(
        fn.flag_between("ship", "on", "off", 1, 1).alias("state"), fn.flag_positive("l_discount").alias("sign")
    )
    return aggregate.row_counts(flags, ["state", "sign"])


@query(f"""select l_linestatus, count(*) as n, {r('sum(l_quantity)', 2)} as quantity from lineitem
    where l_linenumber = 2 and month(l_shipdate) between 3 and 5 and year(l_shipdate) <> 1998
      and l_returnflag in ('A', 'R') and l_quantity is not null group by 1""")
def filter_conjunction(spark, sf_dir):
    date = to_date("l_shipdate")
    kept = rows.drop_missing(table(spark, sf_dir, "lineitem"), ["l_quantity"]).where(
        (F.col("l_linenumber") == 2) & F.month(date).between(3, 5) & (F.year(date) != 1998)
        & F.col("l_returnflag").isin("A", "R")
    )
    return rounded(kept.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    ), 2)


@query("select c_custkey, c_nationkey, c_mktsegment from customer")
def select_except_cols(spark, sf_dir):
    return rounded(rows.select_except(table(spark, sf_dir, "customer"), ["c_name", "c_acctbal"]))


@query(f"""select l_linenumber, count(p) as n, {r('sum(p)', 2)} as total from (
    select l_linenumber, case when obs > 0 then obs when obs <= 0 then 10 + 0.001 * l_extendedprice end as p from (
      select *, case when l_linenumber = 3 then null when l_returnflag = 'R' then 0 else l_quantity end as obs
      from lineitem)) group by 1""")
def prefer_observed(spark, sf_dir):
    observed = F.when(F.col("l_linenumber") == 3, None).when(F.col("l_returnflag") == "R", 0.0).otherwise(
        F.col("l_quantity")
    )
    lines = table(spark, sf_dir, "lineitem").withColumn("obs", observed)
    best = lines.select(
        "l_linenumber", fn.prefer_observed("obs", 10 + 0.001 * F.col("l_extendedprice")).alias("p")
    )
    return rounded(best.groupBy("l_linenumber").agg(F.count("p").alias("n"), F.sum("p").alias("total")), 2)


@query("""select p_partkey, p_size as s1, p_size * p_size as s2, p_size * p_size * p_size as s3 from part""")
def power_terms(spark, sf_dir):
    s1, s2, s3 = fn.power_terms("p_size", 3)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", s1.alias("s1"), s2.alias("s2"), s3.alias("s3")))


@query("select event_id, event_type, user_id from events where event_id % 7 = 0")
def keep_missing(spark, sf_dir):
    return rounded(rows.keep_missing(events_with_gaps(spark, sf_dir), "value").select("event_id", "event_type", "user_id"))


# ------------------------------------------------------------------- joins


def daily_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(to_date("o_orderdate").alias("Date")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.log("o_totalprice")).alias("price")
    )


def daily_lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(
        to_date("l_shipdate").alias("DATE")
    ).agg(F.avg(F.log("l_extendedprice")).alias("cost"))


_DAILY = """o as (select cast(o_orderdate as date) as d, count(*) as n, avg(ln(o_totalprice)) as price from orders group by 1),
  l as (select cast(l_shipdate as date) as d, avg(ln(l_extendedprice)) as cost from lineitem
    group by 1)"""


@query(f"""with {_DAILY} select cast(o.d as varchar) as "Date", n, {r('price')} as price, {r('cost')} as cost
    from o join l using (d)""")
def join_inner_daily(spark, sf_dir):
    both = joins.join_on(daily_orders(spark, sf_dir), daily_lines(spark, sf_dir), {"Date": "DATE"})
    return rounded(both)


@query(f"""with {_DAILY} select cast(o.d as varchar) as "Date", n, {r('cost')} as cost
    from o left join l using (d) where cost is not null""")
def join_left_daily(spark, sf_dir):
    lines = daily_lines(spark, sf_dir).withColumnRenamed("DATE", "Date")
    both = joins.join_on(daily_orders(spark, sf_dir).select("Date", "n"), lines, ["Date"], "left")
    return rounded(rows.drop_missing(both, ["cost"]))


@query(f"""with o as (select cast(o_orderdate as date) as d, avg(ln(o_totalprice)) as price from orders group by 1)
    select l_returnflag, l_linestatus, count(c) as n, {r('avg(c)')} as cost from (
      select l_returnflag, l_linestatus,
        coalesce(case when l_linenumber <> 4 then ln(l_extendedprice) end, price) as c
      from lineitem left join o on cast(l_shipdate as date) = o.d) group by 1, 2""")
def fill_from_lookup(spark, sf_dir):
    cost = F.when(F.col("l_linenumber") != 4, F.log("l_extendedprice")).alias("cost")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", to_date("l_shipdate").alias("ship"), cost
    )
    filled = joins.fill_from(lines, daily_orders(spark, sf_dir), {"ship": "Date"}, {"cost": "price"})
    return rounded(filled.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("cost").alias("n"), F.avg("cost").alias("cost")
    ))


@query("""with spans as (
      select o_custkey, year(o_orderdate) as year, min(cast(o_orderdate as date)) as lo,
        max(cast(o_orderdate as date)) as hi from orders group by 1, 2),
    points as (
      select o_custkey, year(l_shipdate) as year, cast(l_shipdate as date) as d
      from lineitem join orders on l_orderkey = o_orderkey)
    select o_custkey, year, count(*) as n, cast(min(d) as varchar) as first, cast(max(d) as varchar) as last
    from points join spans using (o_custkey, year) where d between lo - 1 and hi + 1 group by 1, 2""")
def interval_join_spans(spark, sf_dir):
    date = to_date("o_orderdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", date.alias("ordered"))
    keys = ["o_custkey", "year"]
    spans = orders.groupBy("o_custkey", F.year("ordered").alias("year")).agg(
        F.min("ordered").alias("on"), F.max("ordered").alias("off")
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", to_date("l_shipdate").alias("ship"))
    points = joins.join_on(lines, orders, {"l_orderkey": "o_orderkey"}).groupBy(
        "o_custkey", F.year("ship").alias("year"), "ship"
    ).agg(F.count(F.lit(1)).alias("m"))
    inside = joins.interval_join(points, spans, keys, "ship", "on", "off", pad=1)
    return rounded(inside.groupBy(*keys).agg(
        F.sum("m").alias("n"), F.min("ship").alias("first"), F.max("ship").alias("last")
    ))


@query("""select o_orderkey, cast(cast(o_orderdate as date) as varchar) as date from orders
    where cast(o_orderdate as date) in (
      select cast(l_shipdate as date) from lineitem where l_returnflag = 'R' and l_quantity = 50)""")
def semi_in_dates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", to_date("o_orderdate").alias("date"))
    ships = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity = 50").select(
        to_date("l_shipdate").alias("ship")
    )
    return rounded(joins.semi_in(orders, ships, "date", "ship"))


@query("""select year, o_orderpriority, cast(unnest(range(lo, hi + 1)) as bigint) as doy from (
    select year(o_orderdate) as year, o_orderpriority, min(dayofyear(o_orderdate)) - 20 as lo,
      max(dayofyear(o_orderdate)) + 20 as hi from orders group by 1, 2)""")
def expand_seq_groups(spark, sf_dir):
    date = to_date("o_orderdate")
    days = table(spark, sf_dir, "orders").select(F.year(date).alias("year"), "o_orderpriority", F.dayofyear(date).alias("d"))
    return rounded(rows.expand_seq(days, ["year", "o_orderpriority"], F.min("d") - 20, F.max("d") + 20, "doy"))


# -------------------------------------------------------------- aggregates


@query(f"""select year(o_orderdate) as year, dayofyear(o_orderdate) as doy,
      cast(cast(o_orderdate as date) as varchar) as date, count(*) as total,
      count(*) filter (o_orderstatus = 'F') as finished,
      {r("count(*) filter (o_orderstatus = 'F') / count(*)")} as share from orders group by 1, 2, 3""")
def daily_group_counts(spark, sf_dir):
    date = to_date("o_orderdate")
    days = table(spark, sf_dir, "orders").select(
        F.year(date).alias("year"), F.dayofyear(date).alias("doy"), date.alias("date"), "o_orderstatus"
    )
    return rounded(aggregate.group_counts(
        days, ["year", "doy", "date"], F.col("o_orderstatus") == "F", "total", "finished", "share"
    ))


@query(f"""select n_nationkey, n_name, n_regionkey, {r('count(p) / count(*)')} as coverage from (
    select n_nationkey, n_name, n_regionkey, case when o_orderkey % 5 <> 0 then o_totalprice end as p
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    where year(o_orderdate) > 1996) group by 1, 2, 3""")
def coverage_by_station(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where(F.year(to_date("o_orderdate")) > 1996).select(
        "o_custkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price")
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation")
    stations = joins.join_on(
        joins.join_on(orders, customers, {"o_custkey": "c_custkey"}), nations, {"c_nationkey": "n_nationkey"}
    ).withColumnRenamed("c_nationkey", "n_nationkey")
    return rounded(aggregate.coverage(stations, ["n_nationkey", "n_name", "n_regionkey"], "price"))


@query(f"""select cast(d as varchar) as date, {r('avg(p)')} as "meanPrecip", {r('avg(hi)')} as "meanMaxTemp",
      {r('avg(lo)')} as "meanMinTemp", {r('avg(s)')} as "meanSnow", {r('avg(w)')} as "meanWind",
      {r('(avg(hi) + avg(lo)) / 2')} as "meanTemp", count(p) as "N"
    from (select cast(l_shipdate as date) as d, ln(l_quantity) as hi, ln(1 + l_tax) as lo, ln(l_extendedprice) as s,
      case when l_returnflag <> 'A' then ln(1 + l_discount) end as p,
      case when l_linenumber = 7 then ln(l_quantity) end as w from lineitem) group by 1""")
def daily_multi_station_mean(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        to_date("l_shipdate").alias("date"),
        F.log("l_quantity").alias("hi"), F.log(1 + F.col("l_tax")).alias("lo"), F.log("l_extendedprice").alias("s"),
        F.when(F.col("l_returnflag") != "A", F.log(1 + F.col("l_discount"))).alias("p"),
        F.when(F.col("l_linenumber") == 7, F.log("l_quantity")).alias("w"),
    )
    means = dict(meanPrecip="p", meanSnow="s", meanMaxTemp="hi", meanMinTemp="lo", meanWind="w")
    return rounded(aggregate.daily_means(
        lines, "date", means, {"meanTemp": ("meanMaxTemp", "meanMinTemp")}, ("N", "p")
    ))


@query(f"""select year, o_orderpriority, {r('m')} as mean_day,
      cast(date '1970-01-01' + cast(floor(m) as int) as varchar) as mean_date from (
    select year(o_orderdate) as year, o_orderpriority,
      avg(datediff('day', date '1970-01-01', cast(o_orderdate as date))) as m from orders group by 1, 2)""")
def mean_date_by_year(spark, sf_dir):
    date = to_date("o_orderdate")
    days = table(spark, sf_dir, "orders").select(F.year(date).alias("year"), "o_orderpriority", date.alias("date"))
    return rounded(aggregate.mean_date(days, ["year", "o_orderpriority"], "date"))


@query("""select year(l_shipdate) + case when month(l_shipdate) >= 7 then 1 else 0 end as season, l_returnflag,
    count(*) as n from lineitem group by 1, 2""")
def group_row_counts(spark, sf_dir):
    season = fn.season_year(to_date("l_shipdate")).cast("bigint").alias("season")
    return aggregate.row_counts(table(spark, sf_dir, "lineitem").select(season, "l_returnflag"), ["season", "l_returnflag"])


@query(f"""with {_GAPS} select event_type, count(v) as n_value, count(*) - count(v) as missing_value,
    count(props) as n_props, count(*) - count(props) as missing_props from gaps group by 1""")
def missing_counts(spark, sf_dir):
    return aggregate.missing_counts(events_with_gaps(spark, sf_dir), ["value", "props"], ["event_type"])


@query("""select o_custkey, min(dayofyear(o_orderdate)) - 20 as first, max(dayofyear(o_orderdate)) + 20 as last
    from orders group by 1""")
def padded_group_range(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select("o_custkey", F.dayofyear(to_date("o_orderdate")).alias("doy"))
    return rounded(aggregate.padded_range(days, ["o_custkey"], "doy", 20))


@query(f"""select l_returnflag, {r('count(*)::double', 4)} as n, {r('sum(x)', 4)} as sx, {r('sum(x*x)', 4)} as sx2,
      {r('sum(x*x*x)', 4)} as sx3, {r('sum(x*x*x*x)', 4)} as sx4, {r('sum(y)', 4)} as sy, {r('sum(y*y)', 4)} as sy2,
      {r('sum(x*y)', 4)} as sxy, {r('sum(x*x*y)', 4)} as sx2y
    from (select l_returnflag, l_quantity / 7 as x, l_tax as y from lineitem) group by 1""")
def regression_moments(spark, sf_dir):
    xy = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") / 7).alias("x"), F.col("l_tax").alias("y"))
    return rounded(xy.groupBy("l_returnflag").agg(*aggregate.moments("x", "y").values()), 4)


@query(f"""select l_returnflag, l_linestatus,
    {r('sum(l_extendedprice * l_quantity) / sum(l_quantity)', 3)} as mean from lineitem group by 1, 2""")
def weighted_mean_groups(spark, sf_dir):
    mean = aggregate.weighted_mean("l_extendedprice", "l_quantity").alias("mean")
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(mean), 3)


@query(f"select o_orderpriority, {r('median(o_totalprice)')} as median from orders group by 1")
def median_groups(spark, sf_dir):
    return rounded(aggregate.medians(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice"))


@query(f"""select l_returnflag, {r('min(l_extendedprice)', 3)} as min, {r('quantile_cont(l_extendedprice, 0.25)', 3)} as q1,
      {r('quantile_cont(l_extendedprice, 0.5)', 3)} as median, {r('quantile_cont(l_extendedprice, 0.75)', 3)} as q3,
      {r('avg(l_extendedprice)', 3)} as mean, {r('max(l_extendedprice)', 3)} as max from lineitem group by 1""")
def five_number_summary(spark, sf_dir):
    return rounded(aggregate.five_numbers(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice"), 3)


@query(f"""select o_orderpriority, cast(b as bigint) as bin, count(*) as n, case when b >= 0 then {r('b * 25000.0')} end as low,
      case when b < 20 then {r('(b + 1) * 25000.0')} end as high from (
    select o_orderpriority, case when o_totalprice < 0 then -1 when o_totalprice > 500000 then 20
      else least(floor(o_totalprice / 25000.0), 19) end as b from orders) group by o_orderpriority, b""")
def histogram_bins(spark, sf_dir):
    bins = aggregate.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 0.0, 500000.0, 20, ["o_orderpriority"])
    return rounded(bins)


# ----------------------------------------------------------------- scalars

_LAT = "radians(46.06413190)"
_DECL = "asin(0.39795 * cos(0.2163108 + 2 * atan(0.9671396 * tan(0.0086 * (doy - 186)))))"


@query(f"""with d as (select cast(o_orderdate as date) as d, dayofyear(o_orderdate) as doy, count(*) as n
      from orders group by 1, 2),
    p as (select *, {_DECL} as p from d)
    select cast(d as varchar) as date, doy, n, {r(f'''24 - 24 / pi() * acos(greatest(-1, least(1,
      (sin(radians(0.8333)) + sin({_LAT}) * sin(p)) / (cos({_LAT}) * cos(p)))))''')} as hours from p""")
def daylength_daily(spark, sf_dir):
    days = daily_orders(spark, sf_dir).withColumn("doy", fn.day_of_year("Date"))
    return rounded(days.select(
        F.col("Date").alias("date"), "doy", "n", fn.daylength(LATITUDE, "doy").alias("hours")
    ))


@query("""select o_orderkey, dayofyear(o_orderdate) as doy, cast(cast(o_orderdate as date) as varchar) as date from orders""")
def doy_roundtrip(spark, sf_dir):
    date = to_date("o_orderdate")
    doys = table(spark, sf_dir, "orders").select("o_orderkey", F.year(date).alias("y"), fn.day_of_year(date).alias("doy"))
    return rounded(doys.select("o_orderkey", "doy", fn.date_from_doy("y", "doy").alias("date")))


@query(f"""select month, case when f > 0 and o > 0 then {r('ln(f / o)')} end as lnrs from (
    select year(o_orderdate) * 100 + month(o_orderdate) as month,
      sum(case when o_orderstatus = 'F' then o_totalprice end) as f,
      sum(case when o_orderstatus = 'O' then o_totalprice end) as o from orders group by 1)""")
def log_ratio(spark, sf_dir):
    date, price = to_date("o_orderdate"), F.col("o_totalprice")
    sums = table(spark, sf_dir, "orders").groupBy((F.year(date) * 100 + F.month(date)).alias("month")).agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", price)).alias("f"),
        F.sum(F.when(F.col("o_orderstatus") == "O", price)).alias("o"),
    )
    return rounded(sums.select("month", fn.log_ratio("f", "o").alias("lnrs")))


@query(f"""select l_linenumber, l_returnflag, count(m) as n, {r('sum(m)', 3)} as total from (
    select l_linenumber, l_returnflag, case when a is null then b when b is null then a else (a + b) / 2 end as m from (
      select *, case when l_linenumber not in (2, 5) then l_quantity end as a,
        case when l_returnflag <> 'A' and l_linenumber <> 5 then l_discount end as b from lineitem)) group by 1, 2""")
def row_mean_cols(spark, sf_dir):
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    mean = fn.row_mean(
        F.when(~line.isin(2, 5), F.col("l_quantity")), F.when((flag != "A") & (line != 5), F.col("l_discount"))
    )
    means = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag", mean.alias("m"))
    return rounded(means.groupBy("l_linenumber", "l_returnflag").agg(F.count("m").alias("n"), F.sum("m").alias("total")), 3)


@query("""select o_orderpriority, cast(cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as varchar) as date
    from (select o_orderpriority, min(cast(o_orderdate as date)) as lo, max(cast(o_orderdate as date)) as hi
      from orders group by 1)""")
def date_spine(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select("o_orderpriority", to_date("o_orderdate").alias("day"))
    return rounded(rows.date_spine(days, ["o_orderpriority"], "day"))
