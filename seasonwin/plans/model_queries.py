"""Regression and additive models on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seasonwin.functions import basis
from seasonwin.functions.columns import daylength, day_of_year
from seasonwin.operators import grouped, models
from seasonwin.plans.registry import query, r, rounded, table, to_date
from seasonwin.plans.table_queries import LATITUDE
from seasonwin.session import pin

_LINE = """fits as (select l_returnflag, count(*) as n, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept,
    regr_r2(y, x) as r2, regr_syy(y, x) * (1 - regr_r2(y, x)) as rss, regr_sxx(y, x) as sxx
  from xy group by 1)"""
_XY = "xy as (select l_returnflag, l_orderkey, l_linenumber, l_quantity as x, ln(l_extendedprice) as y from lineitem)"


def lines_xy(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linenumber", F.col("l_quantity").alias("x"), F.log("l_extendedprice").alias("y")
    )


@query(f"""with {_XY}, {_LINE} select l_returnflag, n, {r('intercept')} as intercept, {r('slope')} as slope,
    {r('sqrt(rss / ((n - 2) * sxx))')} as se_slope, {r('r2')} as r2, {r('rss')} as rss from fits""")
def fit_linear(spark, sf_dir):
    return rounded(models.fit_linear(lines_xy(spark, sf_dir), "y", "x", ["l_returnflag"]))


@query(f"""with {_XY}, {_LINE} select l_returnflag, l_linenumber, count(*) as n, {r('avg(fit)')} as fit
    from (select xy.*, f.intercept + f.slope * xy.x as fit from xy join fits f using (l_returnflag)) group by 1, 2""")
def score_linear(spark, sf_dir):
    xy = lines_xy(spark, sf_dir)
    scored = models.score_linear(xy, models.fit_linear(xy, "y", "x", ["l_returnflag"]), "x", ["l_returnflag"])
    return rounded(scored.groupBy("l_returnflag", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.avg("fit").alias("fit")
    ))


@query(f"""with {_XY}, {_LINE} select l_returnflag, l_linenumber, {r('avg(e)')} as mean_resid,
      {r('var_samp(e)')} as var_resid, {r('min(e)')} as low, {r('max(e)')} as high
    from (select xy.*, xy.y - f.intercept - f.slope * xy.x as e from xy join fits f using (l_returnflag)) group by 1, 2""")
def residual_summary(spark, sf_dir):
    xy = lines_xy(spark, sf_dir)
    scored = models.score_linear(xy, models.fit_linear(xy, "y", "x", ["l_returnflag"]), "x", ["l_returnflag"])
    resid = scored.withColumn("e", F.col("y") - F.col("fit"))
    return rounded(resid.groupBy("l_returnflag", "l_linenumber").agg(
        F.avg("e").alias("mean_resid"), F.var_samp("e").alias("var_resid"),
        F.min("e").alias("low"), F.max("e").alias("high"),
    ))


def _bump_sql(u: str) -> str:
    return (f"case when {u} < 1 then (4 - 6 * {u} * {u} + 3 * {u} * {u} * {u}) / 6 "
            f"when {u} < 2 then (2 - {u}) * (2 - {u}) * (2 - {u}) / 6 else 0 end")


@query(f"""select doy, i, count(*) as n, {r('any_value(s)')} as spline, {r('any_value(c)')} as cyclic from (
    select doy, i, {_bump_sql('u')} as s, {_bump_sql('v')} as c from (
      select doy, i, abs(doy - (1 + (i - 1) * 365.0 / 3)) / (365.0 / 3) as u,
        least((doy - 80 - i * 70.0 / 6 + 700) % 70, 70 - (doy - 80 - i * 70.0 / 6 + 700) % 70) / (70.0 / 6) as v
      from (select dayofyear(o_orderdate)::double as doy, unnest(range(0, 6)) as i from orders))) group by 1, 2""")
def spline_basis_rows(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(day_of_year(to_date("o_orderdate")).cast("double").alias("doy"))
    per_day = days.groupBy("doy").agg(F.count(F.lit(1)).alias("n"))
    both = F.arrays_zip(
        basis.spline_basis("doy", 1.0, 366.0, 6).alias("spline"), basis.cyclic_basis("doy", 80.0, 150.0, 6).alias("cyclic")
    )
    elements = per_day.select("doy", "n", F.posexplode(both).alias("i", "b"))
    return rounded(elements.select("doy", "n", "i", F.col("b.spline").alias("spline"), F.col("b.cyclic").alias("cyclic")))


#: Second derivatives at the inner two of four knots, from the two equations of continuous slopes.
_BEND = """b as (select 50.0::double as h0, 150.0::double as h1, 100.0::double as h2),
    m as (select *, (h0 + h1) / 3 as p, h1 / 6 as q, (h1 + h2) / 3 as r from b),
    g as (select i, case i when 0 then 1 / h0 when 1 then -1 / h0 - 1 / h1 when 2 then 1 / h1 else 0 end as d1,
      case i when 1 then 1 / h1 when 2 then -1 / h1 - 1 / h2 when 3 then 1 / h2 else 0 end as d2, p, q, r
      from m, (select unnest(range(0, 4)) as i)),
    s as (select i, (r * d1 - q * d2) / (p * r - q * q) as s1, (p * d2 - q * d1) / (p * r - q * q) as s2 from g)"""


@query(f"""with {_BEND},
    d as (select dayofyear(o_orderdate)::double as doy, count(*) as n from orders group by 1),
    x as (select *, greatest(20, least(320, doy)) as x from d),
    j as (select *, case when x >= 220 then 2 when x >= 70 then 1 else 0 end as j from x),
    k as (select *, [20, 70, 220, 320][j + 1]::double as low, [20, 70, 220, 320][j + 2]::double as high from j),
    w as (select k.*, s.i, high - low as h, high - x as l, x - low as r, [0, s1, s2, 0] as s from k, s)
    select doy, n, i, {r("case when i = j then l / h when i = j + 1 then r / h else 0 end + (l * l * l / h - h * l) / 6 * s[j + 1] "
      "+ (r * r * r / h - h * r) / 6 * s[j + 2]")} as value from w""")
def natural_basis_rows(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(day_of_year(to_date("o_orderdate")).cast("double").alias("doy"))
    per_day = days.groupBy("doy").agg(F.count(F.lit(1)).alias("n"))
    values = F.posexplode(basis.natural_basis("doy", [20, 70, 220, 320])).alias("i", "value")
    return rounded(per_day.select("doy", "n", values))


def daily_catch(spark, sf_dir):
    """Finished orders per day with the year, day of year and day length."""
    date = to_date("o_orderdate")
    daily = table(spark, sf_dir, "orders").groupBy(date.alias("date")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("catch"), F.avg(F.log("o_totalprice")).alias("price")
    )
    doy = day_of_year("date")
    return pin(daily.select(
        F.year("date").alias("year"), doy.alias("doy"), "catch", "price", daylength(LATITUDE, doy).alias("photoperiod")
    ), "catch")


@query()
def poisson_fit(spark, sf_dir):
    model = models.fit_additive(
        daily_catch(spark, sf_dir), "catch",
        [models.Smooth("doy", 6, cyclic=True, low=1, high=366), models.RandomIntercept("year")], models.POISSON,
    )
    return rounded(model.coefficients(spark), 4)


@query()
def fit_additive(spark, sf_dir):
    daily = daily_catch(spark, sf_dir)
    model = models.fit_additive(
        daily, "price", [models.Smooth("photoperiod", 6), models.Smooth("doy", 8), models.Linear("catch")]
    )
    return rounded(models.fit_summary(daily, model), 4)


@query()
def partial_effect(spark, sf_dir):
    daily = daily_catch(spark, sf_dir)
    model = models.fit_additive(
        daily, "catch", [models.Smooth("price", 6), models.Smooth("photoperiod", 6)], models.QUASIPOISSON
    )
    return rounded(models.partial_effect(daily, model, "s(price)"), 4)


@query()
def effect_surface(spark, sf_dir):
    daily = daily_catch(spark, sf_dir)
    terms = [
        models.Smooth("price", 6), models.Smooth("photoperiod", 6),
        models.Tensor(models.Smooth("photoperiod", 5), models.Smooth("price", 5)),
    ]
    model = models.fit_additive(daily, "catch", terms, models.POISSON)
    return rounded(models.effect_surface(daily, model, "price", "photoperiod"), 4)


@query(f"""with d as (
      select cast(o_orderdate as date) as date, year(o_orderdate) as year, ln(avg(o_totalprice)) as y,
        count(*)::double as x from orders group by 1, 2),
    s as (select count(*) as n, regr_syy(y, x) as syy, regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) as line from d),
    g as (select sum(w) as within from (select regr_syy(y, 1) as w from d group by year)),
    m as (
      select 'flat' as model, n, 1 as p, syy as rss from s union all
      select 'line', n, 2, syy - line from s union all
      select 'years', n, (select count(distinct year) from d), within from s, g)
    select model, n, p, {r('rss')} as deviance, {r('n * (ln(2 * pi() * rss / n) + 1) + 2 * (p + 1)', 3)} as aic from m""")
def compare_models(spark, sf_dir):
    date = to_date("o_orderdate")
    daily = pin(table(spark, sf_dir, "orders").groupBy(date.alias("date"), F.year(date).alias("year")).agg(
        F.log(F.avg("o_totalprice")).alias("y"), F.count(F.lit(1)).cast("double").alias("x")
    ), "daily")
    fits = {
        "flat": models.fit_additive(daily, "y", []),
        "line": models.fit_additive(daily, "y", [models.Linear("x")]),
        # Without a penalty the random intercept is a free mean per year.
        "years": models.fit_additive(daily, "y", [models.RandomIntercept("year")], lambdas=[0.0]),
    }
    table_ = models.compare_models(spark, fits)
    return rounded(
        table_.select("model", "n", F.round("edf").cast("long").alias("p"), "deviance", "aic"), aic=3
    )


@query(f"""with d as (select year(o_orderdate) as year, ln(avg(o_totalprice)) as y from orders group by o_orderdate, 1),
    g as (select sum(w) as rss, count(*) as k, sum(n) as n from (select regr_syy(y, 1) as w, count(*) as n from d group by year)),
    t as (select rss, k, n, flat - rss as diff, (flat - rss) / (k - 1) / (rss / (n - k)) as f, flat from g, (select regr_syy(y, 1) as flat from d)),
    x as (select *, (n - k) / 2.0::double as b, (n - k) / ((n - k) + (k - 1) * f) as x from t),
    -- With an even number of degrees of freedom the tail is a finite sum.
    p as (select sum(exp(b * ln(x) + lgamma(b + j) - lgamma(b) - lgamma(j + 1) + j * ln(1 - x))) as p
      from (select *, unnest(range(0, (k - 1) // 2)) as j from x))
    select 'flat' as model, (n - 1)::double as resid_df, {r('flat')} as deviance, null::double as df, null::double as difference,
      null::double as statistic, null::double as p from t
    union all select 'years', n - k, {r('rss')}, k - 1, {r('diff')}, {r('f')}, {r('p')} from t, p""")
def nested_models(spark, sf_dir):
    """Does the mean log price differ between years?"""
    date = to_date("o_orderdate")
    daily = pin(table(spark, sf_dir, "orders").groupBy(date.alias("date"), F.year(date).alias("year")).agg(
        F.log(F.avg("o_totalprice")).alias("y")
    ), "daily")
    flat = models.fit_additive(daily, "y", [])
    years = models.fit_additive(daily, "y", [models.RandomIntercept("year")], lambdas=[0.0])
    tests = models.nested_tests(spark, [("flat", flat), ("years", years)])
    return rounded(tests).withColumns({c: F.round(c, 4) + F.lit(0.0) for c in ("resid_df", "df")})


@query(f"""with d as (select year(o_orderdate) as year, dayofyear(o_orderdate) as doy, sum(ln(o_totalprice)) as fit
      from orders group by 1, 2),
    c as (select *, sum(fit) over (partition by year order by doy) / sum(fit) over (partition by year) as share,
      row_number() over (partition by year order by fit desc, doy) as k from d)
    select year, min(doy) filter (k = 1) as peak, min(doy) filter (share >= 0.025 - 1e-12) as lower,
      min(doy) filter (share >= 0.975 - 1e-12) as upper from c group by 1""")
def phenology_peak(spark, sf_dir):
    date = to_date("o_orderdate")
    daily = table(spark, sf_dir, "orders").groupBy(F.year(date).alias("year"), F.dayofyear(date).alias("doy")).agg(
        F.sum(F.log("o_totalprice")).alias("fit")
    )
    return rounded(models.phenology_peak(daily, ["year"], "doy", "fit"))


#: Gauss-Jordan elimination of one system: ``m`` is a list of rows, the right-hand side in the last column.
_ELIMINATE = """list_transform(m, lambda row, i: case when i = step + 1 then list_transform(row, lambda v: v / m[step + 1][step + 1])
      else list_transform(row, lambda v, j: v - row[step + 1] * m[step + 1][j] / m[step + 1][step + 1]) end)"""


@query(f"""with recursive d as (
      select cast(o_orderdate as date) as date, year(o_orderdate) as year, dayofyear(o_orderdate)::double as doy,
        ln(avg(o_totalprice)) as y, count(*)::double as x from orders group by 1, 2, 3),
    l as (select year, (row_number() over (order by year) - 1) as l from (select distinct year from d)),
    q as (select count(*) as levels from l),
    e as (
      select date, 0 as c, 1.0::double as v from d union all
      select date, 1, x - (select avg(x) from d) from d union all
      select date, 2 + 7 * l, 1.0::double from d join l using (year) union all
      select date, 3 + 7 * l + i, {_bump_sql('u')} from (
        select date, l, i, least((doy - 1 - i * 365.0 / 6 + 3650) % 365, 365 - (doy - 1 - i * 365.0 / 6 + 3650) % 365) / (365.0 / 6) as u
        from d join l using (year), (select unnest(range(0, 6)) as i))),
    s as (select c from (select unnest(range(0, 2 + 7 * levels)) as c from q)),
    xx as (select a.c as i, b.c as j, sum(a.v * b.v) as v from e a join e b on a.date = b.date group by 1, 2),
    xy as (select c as i, sum(v * y) as v from e join d on d.date = e.date group by 1),
    pen as (
      select a.c as i, b.c as j, case
        when a.c < 2 or b.c < 2 or (a.c - 2) // 7 <> (b.c - 2) // 7 then 0.0
        when (a.c - 2) % 7 = 0 or (b.c - 2) % 7 = 0 then case when a.c = b.c then 5.0 else 0.0 end
        else 2.0 * case abs(a.c - b.c) when 0 then 6.01 when 1 then -4.0 when 5 then -4.0 when 2 then 1.0 when 4 then 1.0 else 0.0 end
      end as v from s a, s b),
    cells as (
      select i, j, coalesce(xx.v, 0) + pen.v as v from pen left join xx using (i, j)
      union all select c, (select 2 + 7 * levels from q), coalesce(xy.v, 0) from s left join xy on xy.i = s.c),
    g as (
      select 0 as step, list(r order by i) as m from (select i, list(v::double order by j) as r from cells group by i)
      union all select step + 1, {_ELIMINATE} from g where step < len(m)),
    t as (select m from g order by step desc limit 1)
    select year, case when k = 0 then 're(year)' else 's(doy,year)' end as term, greatest(k - 1, 0)::bigint as i,
      {r('m[3 + 7 * l + k][-1]', 5)} as estimate
    from l, t, (select unnest(range(0, 7)) as k)""")
def fit_group_curves(spark, sf_dir):
    """An intercept and a yearly curve of the log price per year, beside a line in the number of orders."""
    date = to_date("o_orderdate")
    daily = table(spark, sf_dir, "orders").groupBy(date.alias("date")).agg(
        F.log(F.avg("o_totalprice")).alias("y"), F.count(F.lit(1)).cast("double").alias("x")
    ).select(F.year("date").alias("year"), day_of_year("date").cast("double").alias("doy"), "x", "y")
    curve = models.Smooth("doy", 6, cyclic=True, low=1, high=366)
    terms = [models.Linear("x"), models.RandomIntercept("year"), models.BySmooth(curve, "year", shared=True)]
    model = grouped.fit_grouped(daily, "y", terms, "year", lambdas=[5.0, 2.0])
    return rounded(grouped.group_coefficients(model).drop("se"), 5)


@query(f"""with d as (select o_custkey as g, ln(o_totalprice) as y, dayofyear(o_orderdate)::double as doy from orders),
    e as (select g, y, doy - (select avg(doy) from d) as x from d),
    l as (select g, count(*)::double as n, sum(x) as sx, sum(y) as sy, count(*) + 4.0 as d from e group by g),
    a as (select sum(n) - sum(n * n / d) as a, sum(sx) - sum(n * sx / d) as b, (select sum(x * x) from e) - sum(sx * sx / d) as c,
      sum(sy) - sum(n * sy / d) as r, (select sum(x * y) from e) - sum(sx * sy / d) as t from l),
    w as (select (c * r - b * t) / (a * c - b * b) as b0, (a * t - b * r) / (a * c - b * b) as b1,
      c / (a * c - b * b) as v00, -b / (a * c - b * b) as v01, a / (a * c - b * b) as v11 from a),
    f as (select g, (sy - n * b0 - sx * b1) / d as u, b0, b1,
      1 / d + (n * n * v00 + 2 * n * sx * v01 + sx * sx * v11) / (d * d) as v from l, w),
    s as (select sum((y - b0 - b1 * x - u) * (y - b0 - b1 * x - u)) as rss, count(*) as n from e join f using (g)),
    p as (select rss / (n - 2 - (select sum(1 - 4.0 * v) from f)) as scale from s)
    select g as o_custkey, {r('u', 5)} as estimate, {r('sqrt(v * scale)', 5)} as se from f, p""")
def customer_intercepts(spark, sf_dir):
    """A shrunk intercept for every customer."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", F.log("o_totalprice").alias("y"), day_of_year(to_date("o_orderdate")).cast("double").alias("doy")
    )
    model = grouped.fit_grouped(orders, "y", [models.Linear("doy"), models.RandomIntercept("o_custkey")], "o_custkey", lambdas=[4.0])
    return rounded(grouped.group_coefficients(model).select("o_custkey", "estimate", "se"), 5)
