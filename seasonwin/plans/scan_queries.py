"""The window scan on the given tables: which days of order value and shipped
quantity before each month best predict the month's ratio of order values?"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonwin.functions.columns import bucket_ranges, log_ratio
from seasonwin.operators import randomise, scan
from seasonwin.operators.joins import relative_series as relative_series_op
from seasonwin.operators.rows import expand_grid
from seasonwin.plans.registry import query, r, rounded, table, to_date
from seasonwin.session import pin

START, STOP, EXCLUDE = 120, -150, (10, -150)
LEVEL = 0.95
REPEATS, SEED = 100, 7
PERIODS = [(1995, 1996, "past"), (1997, 1998, "mid")]


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two complete daily series: mean log order price and mean log shipped quantity."""
    price = table(spark, sf_dir, "orders").groupBy(to_date("o_orderdate").alias("date")).agg(
        F.avg(F.log("o_totalprice")).alias("value")
    )
    quantity = table(spark, sf_dir, "lineitem").groupBy(to_date("l_shipdate").alias("date")).agg(
        F.avg(F.log("l_quantity")).alias("value")
    )
    both = price.withColumn("variable", F.lit("price")).unionByName(quantity.withColumn("variable", F.lit("quantity")))
    return pin(scan.complete_series(both), "series")


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per month: log ratio of the prices of finished and open orders."""
    status = F.col("o_orderstatus")
    monthly = (
        table(spark, sf_dir, "orders")
        .groupBy(F.trunc(to_date("o_orderdate"), "month").alias("bdate"))
        .agg(
            F.sum(F.when(status == "F", F.col("o_totalprice"))).alias("_f"),
            F.sum(F.when(status == "O", F.col("o_totalprice"))).alias("_o"),
        )
        .withColumn("y", log_ratio("_f", "_o"))
        .where("y is not null")
    )
    year = F.year("bdate")
    return monthly.select(
        (year * 100 + F.month("bdate")).alias("event_id"), "bdate", "y",
        bucket_ranges(year, PERIODS, "present").alias("period"),
    )


def _scan(spark, sf_dir, stats=(scan.MEAN, scan.SLOPE), funcs=(scan.LIN, scan.QUAD), group=()) -> DataFrame:
    return scan.scan_windows(
        order_events(spark, sf_dir), order_series(spark, sf_dir), START, STOP, EXCLUDE, stats, funcs, group=group
    )


_SERIES = """
raw as (
  select 'price' as variable, cast(o_orderdate as date) as date, avg(ln(o_totalprice)) as v
  from orders group by 2
  union all
  select 'quantity', cast(l_shipdate as date), avg(ln(l_quantity)) from lineitem group by 2),
spine as (
  select variable, cast(unnest(days) as date) as date
  from (select variable, generate_series(min(date), max(date), interval 1 day) as days from raw group by 1)),
near as (
  select s.variable, s.date,
    coalesce(v, avg(v) over (partition by s.variable order by s.date rows between 2 preceding and 2 following)) as v,
    row_number() over (partition by s.variable order by s.date) as rn
  from spine s left join raw using (variable, date)),
marks as (
  select *,
    max(case when v is not null then rn end) over (partition by variable order by rn) as p,
    min(case when v is not null then rn end) over (partition by variable order by rn
      rows between current row and unbounded following) as q
  from near),
series as (
  select m.variable, m.date,
    case when m.v is not null then m.v else a.v + (b.v - a.v) * (m.rn - m.p) / (m.q - m.p) end as value
  from marks m
  left join near a on a.variable = m.variable and a.rn = m.p
  left join near b on b.variable = m.variable and b.rn = m.q)"""

def _events(start: int, stop: int) -> str:
    return _EVENTS_TEXT.format(start=start, stop=stop)


_EVENTS_TEXT = """
monthly as (
  select cast(date_trunc('month', o_orderdate) as date) as bdate,
    sum(case when o_orderstatus = 'F' then o_totalprice end) as f,
    sum(case when o_orderstatus = 'O' then o_totalprice end) as o
  from orders group by 1),
events0 as (
  select year(bdate) * 100 + month(bdate) as event_id, bdate, ln(f / o) as y,
    case when year(bdate) between 1995 and 1996 then 'past'
         when year(bdate) between 1997 and 1998 then 'mid' else 'present' end as period
  from monthly where f > 0 and o > 0),
ends as (select variable, min(date) as d0, max(date) as d1 from series group by 1),
ev as (
  select e.*, ends.variable from events0 e, ends
  where e.bdate - ({start}) >= d0 and e.bdate - ({stop}) <= d1)"""
_EVENTS = _events(START, STOP)

_REL = """
rel as (
  select e.variable, e.period, e.event_id, e.y, datediff('day', s.date, e.bdate) as o, s.value,
    sum(s.value) over past as cs, sum(s.value * datediff('day', s.date, e.bdate)) over past as ct
  from ev e join series s on {match} and s.date between e.bdate - ({start}) and e.bdate - ({stop})
  window past as (partition by e.variable, e.event_id order by s.date desc)),
offsets as (select cast(unnest(range({stop}, {start} + 1)) as int) as o),
windows as (
  select a.o as open, b.o as close, a.o - b.o + 1.0::double as days from offsets a, offsets b
  where a.o >= b.o and not (a.o - b.o + 1 <= {days} and b.o >= {edge}))"""


def _rel(match: str = "s.variable = e.variable") -> str:
    return _REL.format(match=match, start=START, stop=STOP, days=EXCLUDE[0], edge=EXCLUDE[1])


#: A window's sums are differences of two days' running sums.
_TOTAL = "a.cs - b.cs + b.value as total, a.ct - b.ct + b.value * w.close as moment"
_SLOPE = "((open + close) / 2.0::double * total - moment) / (days * (days * days - 1) / 12)"
_X = f"""
w0 as (
  select a.variable, a.period, a.event_id, a.y, w.open, w.close, w.days, {_TOTAL}
  from windows w join rel a on a.o = w.open join rel b on b.variable = a.variable and b.event_id = a.event_id and b.o = w.close),
x as (
  select variable, period, event_id, 'mean' as stat, open, close, y, total / days as x from w0
  union all
  select variable, period, event_id, 'slope', open, close, y, {_SLOPE} from w0 where days > 1)"""


def _fits(group: str = "") -> str:
    """Fits from central sums, linear ones and quadratic ones in the square's deviation from its mean."""
    a = 2 * math.pi
    combo = f"{group}, variable, stat".lstrip(", ")
    k = f"{combo}, open, close"
    return f"""
mid as (select {k}, avg(x) as mx, avg(y) as my from x group by all),
sums as (
  select {k}, count(*) as n, any_value(mx) as mx, any_value(my) as my, sum(z * z) as s2, sum(z * z * z) as s3, sum(z * z * z * z) as s4,
    sum(z * v) as sxy, sum(z * z * v) as suy, sum(v * v) as syy
  from (select x.*, mx, my, x - mx as z, y - my as v from x join mid using ({k})) group by all),
central as (
  select *, s4 - s2 * s2 / n as uu, (s2 * suy - s3 * sxy) / (s2 * (s4 - s2 * s2 / n) - s3 * s3) as c2,
    ((s4 - s2 * s2 / n) * sxy - s3 * suy) / (s2 * (s4 - s2 * s2 / n) - s3 * s3) as c1 from sums),
fits as (
  select {k}, 'lin' as func, n, syy, my - sxy / s2 * mx as b0, sxy / s2 as b1, null::double as b2, syy - sxy * sxy / s2 as rss, 3 as k,
    mx, s2, s3, s4 from central
  union all
  select {k}, 'quad', n, syy, my - c1 * mx - c2 * s2 / n + c2 * mx * mx, c1 - 2 * c2 * mx, c2, syy - c1 * sxy - c2 * suy, 4,
    mx, s2, s3, s4 from central),
crit as (
  select *, n * (ln({a} * rss / n) + 1) + 2 * k + 2.0 * k * (k + 1) / (n - k - 1) as aicc,
    n * (ln({a} * syy / n) + 1) + 4 + 12.0 / (n - 3) as aicc0
  from fits),
scan as (
  select *, 1 - rss / syy as r2, aicc - aicc0 as delta_aicc,
    exp(-(aicc - best) / 2) / sum(exp(-(aicc - best) / 2)) over (partition by {combo}, func) as weight,
    row_number() over (partition by {combo}, func order by aicc, open, close) as rank
  from (select *, min(aicc) over (partition by {combo}, func) as best from crit))"""


def _ctes(*parts: str) -> str:
    return "with " + ",".join(parts)


_SCAN = _ctes(_SERIES, _EVENTS, _rel(), _X, _fits())
#: Rounded so that the last bits of ill-conditioned fits don't show.
_DIGITS = dict(b0=3, b1=2, b2=1, rss=3, r2=3, aicc=3, delta_aicc=3, weight=5)
_COLUMNS = "variable, stat, func, open, close, n, " + ", ".join(f"{r(c, d)} as {c}" for c, d in _DIGITS.items()) + ", rank"


def _scan_sql(stat: str, func: str) -> str:
    return f"{_SCAN} select {_COLUMNS} from scan where stat = '{stat}' and func = '{func}'"


@query(_scan_sql("mean", "lin"))
def scan_lin_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scan(spark, sf_dir, [scan.MEAN], [scan.LIN]), **_DIGITS)


@query(_scan_sql("slope", "lin"))
def scan_lin_slope(spark, sf_dir):
    return rounded(_scan(spark, sf_dir, [scan.SLOPE], [scan.LIN]), **_DIGITS)


@query(_scan_sql("mean", "quad"))
def scan_quad_mean(spark, sf_dir):
    return rounded(_scan(spark, sf_dir, [scan.MEAN], [scan.QUAD]), **_DIGITS)


@query(_scan_sql("slope", "quad"))
def scan_quad_slope(spark, sf_dir):
    return rounded(_scan(spark, sf_dir, [scan.SLOPE], [scan.QUAD]), **_DIGITS)


@query(_ctes(_SERIES, _EVENTS, _rel(), _X, _fits("period")) + f" select period, {_COLUMNS} from scan")
def scan_by_group(spark, sf_dir):
    return rounded(_scan(spark, sf_dir, group=["period"]), **_DIGITS)


@query(
    _ctes(_SERIES, _EVENTS)
    + f""" select e.event_id, e.variable, datediff('day', s.date, e.bdate) as "offset", {r('s.value')} as value
    from ev e join series s on s.variable = e.variable
      and s.date between e.bdate - ({START}) and e.bdate - ({STOP})"""
)
def relative_series(spark, sf_dir):
    rel = relative_series_op(order_events(spark, sf_dir), order_series(spark, sf_dir), START, STOP)
    return rounded(rel.select("event_id", "variable", "offset", "value"))


@query(_ctes(_SERIES, _EVENTS, _rel()) + """
    select e.variable, w.open, w.close, w.open - w.close + 1 as days, count(*) as n_events
    from ev e, windows w group by all""")
def enumerate_windows(spark, sf_dir):
    slices = scan.event_slices(order_events(spark, sf_dir), order_series(spark, sf_dir), START, STOP, parts=())
    counts = slices.groupBy("variable").agg(F.count(F.lit(1)).alias("n_events"))
    windows = scan.enumerate_windows(counts, START, STOP, EXCLUDE)
    return rounded(windows.withColumn("days", F.col("open") - F.col("close") + 1))


def _per_window(spark, sf_dir, stat: str) -> DataFrame:
    """What the values of all events are in each window."""
    values = scan.window_stats(order_events(spark, sf_dir), order_series(spark, sf_dir), START, STOP, [stat], EXCLUDE)
    return rounded(values.where(F.col(stat).isNotNull()).groupBy("variable", "open", "close").agg(
        F.count(F.lit(1)).alias("n"), F.avg(stat).alias("mean"), F.min(stat).alias("low"), F.max(stat).alias("high"),
        F.sum(F.col(stat) * F.col("event_id")).alias("by_event"),
    ), by_event=1)


def _per_window_sql(stat: str) -> str:
    return _ctes(_SERIES, _EVENTS, _rel(), _X) + f""" select variable, open, close, count(*) as n, {r('avg(x)')} as mean, {r('min(x)')} as low,
      {r('max(x)')} as high, {r('sum(x * event_id)', 1)} as by_event from x where stat = '{stat}' group by all"""


@query(_per_window_sql("mean"))
def window_mean(spark, sf_dir):
    return _per_window(spark, sf_dir, scan.MEAN)


@query(_per_window_sql("slope"))
def window_slope(spark, sf_dir):
    return _per_window(spark, sf_dir, scan.SLOPE)


@query(_ctes(_SERIES, _EVENTS) + f"""
    select variable, period, count(*) as n, {r('avg(y)')} as mean_y, {r('regr_syy(y, 1)')} as rss,
      {r(f"count(*) * (ln({2 * math.pi} * regr_syy(y, 1) / count(*)) + 1) + 4 + 12.0 / (count(*) - 3)")} as aicc
    from ev group by 1, 2""")
def baseline_fit(spark, sf_dir):
    """Of the events that the scan fits, those with their whole range in a series."""
    slices = scan.event_slices(order_events(spark, sf_dir), order_series(spark, sf_dir), START, STOP, parts=())
    return rounded(scan.fit_baseline(slices, ["variable", "period"]))


_SET = _SCAN + f""",
cum as (
  select *, sum(weight) over (partition by variable, stat, func order by rank) as cum_weight from scan
  where weight is not null),
best_set as (select * from cum where cum_weight - weight < {LEVEL})"""


@query(_SET + f" select variable, stat, func, open, close, rank, {r('weight')} as weight from best_set")
def confidence_set(spark, sf_dir):
    chosen = scan.confidence_set(_scan(spark, sf_dir), LEVEL)
    return rounded(chosen.select(*scan.COMBO, "open", "close", "rank", "weight"))


@query(_SET + f""" select variable, stat, func, count(*) as n_windows,
    {r('sum(b0 * weight) / sum(weight)', 3)} as b0, {r('sum(b1 * weight) / sum(weight)', 3)} as b1,
    {r('sum(b2 * weight) / sum(weight)', 1)} as b2,
    median(open) as median_open, median(close) as median_close from best_set group by all""")
def average_models(spark, sf_dir):
    return rounded(scan.average_models(scan.confidence_set(_scan(spark, sf_dir), LEVEL)), b0=3, b1=3, b2=1)


@query(_SET + f""" , ends_ as (
    select variable, stat, func, 'open' as "end", open as o from best_set
    union all select variable, stat, func, 'close', close from best_set)
    select variable, stat, func, "end", min(o) as min, {r('quantile_cont(o, 0.25)')} as q1,
      {r('quantile_cont(o, 0.5)')} as median, {r('quantile_cont(o, 0.75)')} as q3, {r('avg(o)')} as mean,
      max(o) as max from ends_ group by all""")
def window_spread(spark, sf_dir):
    return rounded(scan.window_spread(scan.confidence_set(_scan(spark, sf_dir), LEVEL)))


@query(_SCAN + f" select variable, stat, func, open, close, {r('delta_aicc')} as delta_aicc from scan")
def delta_surface(spark, sf_dir):
    return rounded(scan.delta_surface(_scan(spark, sf_dir)))


@query(_SCAN + f""" select variable, stat, func, rank, open, close, {r('delta_aicc')} as delta_aicc
    from scan where rank <= 12""")
def topk_windows(spark, sf_dir):
    best = scan.best_windows(_scan(spark, sf_dir), 12)
    return rounded(best.select(*scan.COMBO, "rank", "open", "close", "delta_aicc"))


@query(_SCAN + f""", order_ as (
    select variable, stat, func, open, close,
      sum(weight) over (partition by variable, stat, func order by weight desc, rank
        rows between unbounded preceding and current row) as cum_weight from scan)
    select variable, stat, func, open, close, {r('cum_weight')} as cum_weight from order_""")
def cumulative_weight(spark, sf_dir):
    from seasonwin.operators.ordered import cumulative_weight as cumulate

    total = cumulate(_scan(spark, sf_dir), "weight", scan.COMBO, ["rank"])
    return rounded(total.select(*scan.COMBO, "open", "close", "cum_weight"))


_LEVERAGE = """(1.0 / n + z * z / s2 + case when func = 'quad' then
      (z * z - s2 / n - s3 / s2 * z) * (z * z - s2 / n - s3 / s2 * z) / (s4 - s2 * s2 / n - s3 * s3 / s2) else 0 end)"""
_INTERVAL = f"sqrt(rss / (n - case when func = 'quad' then 3 else 2 end) * {_LEVERAGE})"


@query(_SCAN + f""", p as (
    select s.variable, s.stat, s.func, x.event_id, s.open, s.close, x.x as climate, x.y as yvar, n, s2, s3, s4, rss, x.x - mx as z,
      s.b0 + s.b1 * x.x + coalesce(s.b2, 0) * x.x * x.x as pred
    from scan s join x on x.variable = s.variable and x.stat = s.stat and x.open = s.open and x.close = s.close
    where s.rank = 1),
  e as (select *, {_INTERVAL} as se from p)
  select variable, stat, func, event_id, open, close, {r('climate')} as climate, {r('yvar')} as yvar, {r('pred')} as pred, {r('se')} as se,
    {r('pred - 1.96 * se')} as "LCI", {r('pred + 1.96 * se')} as "UCI" from e""")
def best_model_data(spark, sf_dir):
    _, data = _best(spark, sf_dir)
    return rounded(data)


def _best(spark, sf_dir, stats=(scan.MEAN, scan.SLOPE), funcs=(scan.LIN, scan.QUAD)):
    """The scan and the data of its best windows, from one series and event table."""
    events, series = pin(order_events(spark, sf_dir), "events"), order_series(spark, sf_dir)
    fits = pin(scan.scan_windows(events, series, START, STOP, EXCLUDE, stats, funcs), "scan")
    return fits, scan.best_model_data(fits, events, series, START, STOP)


_CURVE_STEP = 0.01


@query(_SCAN + f""", best as (
    select s.*, lo, hi from scan s join (select variable, stat, open, close, min(x) as lo, max(x) as hi from x group by all) using (variable, stat, open, close)
    where s.rank = 1 and s.stat = 'mean'),
  grid as (select *, lo + i * {_CURVE_STEP} as climate, lo + i * {_CURVE_STEP} - mx as z from (
    select *, unnest(range(0, cast(floor((hi - lo) / {_CURVE_STEP} + 1e-9) as bigint) + 1)) as i from best)),
  line as (select *, b0 + b1 * climate + coalesce(b2, 0) * climate * climate as pred, {_INTERVAL} as se from grid)
  select variable, stat, func, {r('climate')} as climate, {r('pred')} as pred, {r('se')} as se,
    {r('pred - 1.96 * se')} as "LCI", {r('pred + 1.96 * se')} as "UCI" from line""")
def predict_curve(spark, sf_dir):
    fits, data = _best(spark, sf_dir, [scan.MEAN])
    return rounded(scan.predict_curve(pin(data, "best"), fits, _CURVE_STEP))


#: Linear fits of shuffled responses: a window's product with a repeat's responses is the same
#: difference of running sums, taken of the products of the days.
_RANDOM = f"""{_SCAN},
orders_ as (
  select e.variable, e.event_id, e.y - avg(e.y) over (partition by e.variable, rp.r) as y, rp.r,
    row_number() over (partition by e.variable, rp.r
      order by md5('{SEED}-' || cast(rp.r as varchar) || '-' || cast(e.event_id as varchar)), e.event_id) as pos
  from (select distinct variable, event_id, y from ev) e, (select unnest(range(0, {REPEATS} + 1)) as r) rp),
drawn as (
  select h.variable, h.event_id, d.r as rep, d.y as y
  from orders_ h join orders_ d on d.variable = h.variable and d.pos = h.pos and h.r = 0 and d.r > 0),
days as (
  select d.variable, d.rep, rel.o, sum(d.y * rel.cs) as cs, sum(d.y * rel.ct) as ct, sum(d.y * rel.value) as value
  from drawn d join rel on rel.variable = d.variable and rel.event_id = d.event_id group by all),
d0 as (
  select a.variable, a.rep, w.open, w.close, w.days, {_TOTAL}
  from windows w join days a on a.o = w.open join days b on b.variable = a.variable and b.rep = a.rep and b.o = w.close),
products as (
  select variable, rep, 'mean' as stat, open, close, total / days as sxy from d0
  union all select variable, rep, 'slope', open, close, {_SLOPE} from d0 where days > 1),
shuffled as (
  select p.variable, p.stat, p.rep, p.open, p.close, n, syy, syy - p.sxy * p.sxy / s2 as rss
  from products p join sums s using (variable, stat, open, close)),
best as (
  select variable, stat, 'lin' as func, rep as "repeat", open, close,
    n * ln(rss / syy) + 6 + 24.0 / (n - 4) - 4 - 12.0 / (n - 3) as delta_aicc
  from shuffled qualify row_number() over (partition by variable, stat, rep order by rss, open, close) = 1)"""


def _randomised(events: DataFrame, series: DataFrame) -> DataFrame:
    return randomise.randomise_scan(events, series, REPEATS, SEED, START, STOP, EXCLUDE, funcs=[scan.LIN])


@query(_RANDOM + f' select variable, stat, func, "repeat", open, close, {r("delta_aicc", 4)} as delta_aicc from best')
def randomise_scan(spark, sf_dir):
    return rounded(_randomised(order_events(spark, sf_dir), order_series(spark, sf_dir)), 4)


@query(_RANDOM + f""",
  p as (select b.variable, b.stat, b.func, count(*) as repeats, min(o.delta_aicc) as observed,
    count(*) filter (b.delta_aicc <= o.delta_aicc) / count(*) as p
    from best b join scan o on o.variable = b.variable and o.stat = b.stat and o.func = b.func and o.rank = 1 group by 1, 2, 3)
  select variable, stat, func, repeats, {r('observed', 4)} as observed, {r('p')} as p,
    case when p < 0.001 then '<0.001' else cast(round(p, 3) as varchar) end as p_text from p""")
def permutation_p(spark, sf_dir):
    events, series = pin(order_events(spark, sf_dir), "events"), order_series(spark, sf_dir)
    fits = scan.scan_windows(events, series, START, STOP, EXCLUDE, funcs=[scan.LIN])
    return rounded(randomise.permutation_p(fits, _randomised(events, series)), observed=4)


@query(_RANDOM + f""", edges as (select floor(min(delta_aicc)) as lo, ceil(max(delta_aicc)) as hi from best),
  b as (
    select b.*, lo, (hi - lo) / 10 as width, least(floor((delta_aicc - lo) / ((hi - lo) / 10)), 9) as bin from best b, edges),
  seen as (select variable, stat, func, delta_aicc as observed from scan where rank = 1)
  select variable, stat, func, cast(bin as bigint) as bin, count(*) as n, {r('any_value(lo + bin * width)')} as low,
    {r('any_value(lo + (bin + 1) * width)')} as high, {r('any_value(observed)', 4)} as observed
  from b join seen using (variable, stat, func) group by variable, stat, func, bin""")
def null_histogram(spark, sf_dir):
    events, series = pin(order_events(spark, sf_dir), "events"), order_series(spark, sf_dir)
    fits = scan.scan_windows(events, series, START, STOP, EXCLUDE, funcs=[scan.LIN])
    return rounded(scan.null_histogram(_randomised(events, series), 10, fits), observed=4)


@query(_ctes(_SERIES) + """
  select variable, stat, func, count(*) as n_days from series,
    (select unnest(['mean', 'slope']) as stat), (select unnest(['lin', 'quad']) as func) group by all""")
def expand_grid_combos(spark, sf_dir):
    days = order_series(spark, sf_dir).groupBy("variable").agg(F.count(F.lit(1)).alias("n_days"))
    return expand_grid(days, stat=[scan.MEAN, scan.SLOPE], func=[scan.LIN, scan.QUAD])


def _yearly_sites(spark, sf_dir):
    """A driver series and yearly events per priority, so that events share a site's series."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("site"), to_date("o_orderdate").alias("date"), "o_orderstatus", "o_totalprice"
    )
    series = orders.groupBy("site", "date").agg(F.avg(F.log("o_totalprice")).alias("value"))
    complete = scan.complete_series(series.withColumn("variable", F.lit("price")), ["site", "variable"])
    events = orders.groupBy("site", F.trunc("date", "month").alias("bdate")).agg(
        log_ratio(
            F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))),
            F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))),
        ).alias("y")
    ).where("y is not null").withColumn("event_id", F.concat_ws("-", "site", "bdate"))
    return events, pin(complete, "site-series")


@query(f"{_SCAN} select variable, stat, func, open, close, n, {r('r2', 3)} as r2, {r('delta_aicc', 3)} as delta_aicc, {r('weight', 5)} as weight from scan")
def scan_full_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 34,191 windows from 120 days before to 150 after, all eight combinations."""
    return rounded(_scan(spark, sf_dir).select(*scan.COMBO, "open", "close", "n", "r2", "delta_aicc", "weight"), 3, weight=5)


@query()
def randomise_full_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 shuffles of the scan of all eight combinations; the tests compare smaller ones with a fit of every window and repeat."""
    return rounded(randomise.randomise_scan(order_events(spark, sf_dir), order_series(spark, sf_dir), REPEATS, SEED, START, STOP, EXCLUDE))


_SITE_SERIES = """
raw as (
  select o_orderpriority as site, cast(o_orderdate as date) as date, avg(ln(o_totalprice)) as v
  from orders group by 1, 2),
spine as (
  select site, cast(unnest(days) as date) as date
  from (select site, generate_series(min(date), max(date), interval 1 day) as days from raw group by 1)),
near as (
  select s.site, s.date,
    coalesce(v, avg(v) over (partition by s.site order by s.date rows between 2 preceding and 2 following)) as v,
    row_number() over (partition by s.site order by s.date) as rn
  from spine s left join raw using (site, date)),
marks as (
  select *,
    max(case when v is not null then rn end) over (partition by site order by rn) as p,
    min(case when v is not null then rn end) over (partition by site order by rn
      rows between current row and unbounded following) as q
  from near),
series as (
  select m.site, m.date,
    case when m.v is not null then m.v else a.v + (b.v - a.v) * (m.rn - m.p) / (m.q - m.p) end as value
  from marks m
  left join near a on a.site = m.site and a.rn = m.p
  left join near b on b.site = m.site and b.rn = m.q),
monthly as (
  select o_orderpriority as site, cast(date_trunc('month', o_orderdate) as date) as bdate,
    sum(case when o_orderstatus = 'F' then o_totalprice end) as f,
    sum(case when o_orderstatus = 'O' then o_totalprice end) as o
  from orders group by 1, 2),
ends as (select site, min(date) as d0, max(date) as d1 from series group by 1),
ev as (
  select site || '-' || cast(bdate as varchar) as event_id, '' as period, 'price' as variable, bdate, site,
    ln(f / o) as y
  from monthly join ends using (site)
  where f > 0 and o > 0 and bdate - ({start}) >= d0 and bdate - ({stop}) <= d1)""".format(start=START, stop=STOP)


@query(_ctes(_SITE_SERIES, _rel("s.site = e.site"), _X, _fits()) + f" select {_COLUMNS} from scan")
def scan_shared_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model over the events of all sites, each looking at its own site's series."""
    events, series = _yearly_sites(spark, sf_dir)
    return rounded(scan.scan_windows(events, series, START, STOP, EXCLUDE, on=["site"]), **_DIGITS)
