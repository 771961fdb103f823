"""The window scan: which days before or after an event explain its response?

``events`` has one row per event: ``event_id, bdate, y`` and optional group
columns. ``series`` is long and daily: ``variable, date, value`` and optional
``on`` columns (such as a site) that events share. A window is a pair of
offsets in days before the event, ``open >= close``, negative meaning after.

A linear or quadratic fit needs nine sums only. The daily series is turned into
prefix sums once, so that the mean or slope of any window is a difference of
two array elements. Chunks of events are multiplied as matrices (``products``)
and leave one row per window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonwin.functions.columns import NORMAL_95, day_number, normal_interval
from seasonwin.operators.aggregate import five_numbers, histogram, weighted_mean
from seasonwin.operators.joins import attach, attach_group, join_on
from seasonwin.operators.ordered import cumulative_weight, fill_neighbours, interpolate_linear
from seasonwin.operators.products import MEAN, MOMENTS, SLOPE, spread, window_sums
from seasonwin.operators.rows import decimal_spine
from seasonwin.session import pin

LIN, QUAD = "lin", "quad"
BASELINE_PARAMETERS = 2
PARAMETERS = {LIN: 3, QUAD: 4}
# Sums of squares smaller than this share of their size are rounding errors.
SINGULAR = 1e-12
COMBO = ("variable", "stat", "func")


# ---------------------------------------------------------------- the series


def complete_series(
    series: DataFrame, keys: Sequence[str] = ("variable",), on_gap: str = "interpolate"
) -> DataFrame:
    """One value per calendar day from a series' first to last day; a day given twice counts with its mean.

    A missing day takes the mean of the two days on either side. Days that this
    cannot fill are interpolated, or raise with ``on_gap="error"``.
    The calendar bounds the rows of each series.
    """
    keys = list(keys)
    series = series.groupBy(*keys, "date").agg(F.avg("value").alias("value"))
    following = F.lead("date").over(Window.partitionBy(*keys).orderBy("date"))
    until = F.coalesce(F.date_sub(following, 1), F.col("date"))
    # Each known day is followed by the empty days up to the next one.
    days = series.select(*keys, "date", "value", until.alias("_until")).withColumn(
        "_day", F.explode(F.sequence("date", "_until"))
    )
    full = days.select(
        *keys, F.col("_day").alias("date"), F.when(F.col("_day") == F.col("date"), F.col("value")).alias("value")
    )
    filled = fill_neighbours(full, "value", keys, "date")
    if on_gap == "error":
        hole = F.raise_error(F.concat(F.lit("no value near "), F.col("date").cast("string")))
        return filled.withColumn("value", F.coalesce("value", hole.cast("double")))
    return interpolate_linear(filled, ["value"], keys, ["date"])


def series_blocks(series: DataFrame, keys: Sequence[str], length: int) -> DataFrame:
    """Overlapping blocks of ``2 * length`` days with their values and prefix sums.

    Block k starts at day ``k * length``, so any run of ``length + 1`` days or
    fewer lies whole in the block where it starts. ``sums[i]`` and ``tsums[i]``
    add up the first i values, and the first i values times their position.
    """
    shift = F.col("shift") if "shift" in series.columns else F.lit(0.0)
    day = day_number("date")
    home = F.floor(day / length).cast("int")
    placed = (
        series.withColumn("shift", shift)
        .withColumn("block", F.explode(F.array(home, home - 1)))
        .withColumn("_pos", day - F.col("block") * length)
    )
    w = Window.partitionBy(*keys, "block").orderBy("_pos")
    first = F.min("_pos").over(w)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    summed = (
        placed.withColumn("_first", first)
        .withColumn("_sum", F.sum("value").over(upto))
        .withColumn("_tsum", F.sum(F.col("value") * (F.col("_pos") - F.col("_first"))).over(upto))
    )
    # At most 2 * length rows per block: the series has one row per day.
    days = F.array_sort(F.collect_list(F.struct("_pos", "value", "_sum", "_tsum")))
    start = F.array(F.lit(0.0))
    return (
        summed.groupBy(*keys, "block")
        .agg(days.alias("_d"), F.min("_pos").alias("first"), F.first("shift").alias("shift"))
        .select(
            *keys, "block", "first", "shift",
            F.col("_d.value").alias("values"),
            F.concat(start, F.col("_d._sum")).alias("sums"),
            F.concat(start, F.col("_d._tsum")).alias("tsums"),
        )
    )


def event_slices(
    events: DataFrame, series: DataFrame, start: int, stop: int, on: Sequence[str] = (),
    parts: Sequence[str] = ("sums", "tsums"),
) -> DataFrame:
    """Each event with its own stretch of the series, one row per variable.

    ``value`` are the daily values from ``start`` days before the event on;
    ``sums`` and ``tsums`` the prefix sums there, and ``base`` the position at
    which the stretch starts. Events that the series does not cover whole drop out.
    """
    length = start - stop + 1
    blocks = series_blocks(series, [*on, "variable"], length)
    first_day = day_number("bdate") - start
    keyed = events.withColumn("block", F.floor(first_day / length).cast("int"))
    joined = keyed.join(blocks, [*on, "block"])
    base = first_day - F.col("block") * length - F.col("first")
    covered = joined.withColumn("base", base).where(
        (F.col("base") >= 0) & (F.col("base") + length <= F.size("values"))
    )
    sliced = {"value": ("values", length), "sums": ("sums", length + 1), "tsums": ("tsums", length + 1)}
    # The planner may cut before it filters, and an event that drops out may start before its block.
    first = F.greatest(F.col("base"), F.lit(0)) + 1
    kept = {p: F.slice(F.col(sliced[p][0]), first, sliced[p][1]) for p in parts}
    extra = ["base", "shift"] if "tsums" in parts else []
    return covered.select(*events.columns, "variable", *extra, *[c.alias(p) for p, c in kept.items()])


# --------------------------------------------------------------- the windows


def enumerate_windows(
    df: DataFrame, start: int, stop: int, exclude: tuple[int, int] | None = (10, -150)
) -> DataFrame:
    """Each row with every window between the offsets ``start`` and ``stop``.

    ``exclude=(days, offset)`` drops windows of at most ``days`` days that close
    at ``offset`` or earlier in the event's past.
    """
    offsets = F.sequence(F.lit(stop), F.lit(start))
    opened = df.withColumn("open", F.explode(offsets))
    windows = opened.withColumn("close", F.explode(F.sequence(F.lit(stop), F.col("open"))))
    return windows if exclude is None else windows.where(kept_windows(exclude))


def kept_windows(exclude: tuple[int, int]) -> Column:
    days, offset = exclude
    return ~((_duration() <= days) & (F.col("close") >= offset))


def _duration() -> Column:
    return F.col("open") - F.col("close") + 1


def window_value(stat: str, start: int) -> Column:
    """Mean or daily slope of the series in the window, from prefix sums."""
    lo = F.lit(start) - F.col("open")
    hi = F.lit(start) - F.col("close") + 1

    def between(sums: str) -> Column:
        return F.get(sums, hi) - F.get(sums, lo)

    n = _duration()
    if stat == MEAN:
        return between("sums") / n
    middle = F.col("base") + (lo + hi - 1) / 2
    spread_ = n * (n.cast("double") * n - 1) / 12
    return F.try_divide(between("tsums") - middle * between("sums"), spread_)


def window_stats(
    events: DataFrame, series: DataFrame, start: int, stop: int, stats: Sequence[str] = (MEAN,),
    exclude: tuple[int, int] | None = (10, -150), on: Sequence[str] = (),
) -> DataFrame:
    """Each event and window with the series' mean and/or slope there, as columns."""
    slices = event_slices(events, series, start, stop, on)
    windows = enumerate_windows(spread(slices, "event_id", "variable"), start, stop, exclude)
    return windows.select(
        *events.columns, "variable", "shift", "open", "close", *[window_value(s, start).alias(s) for s in stats]
    )


def center_series(series: DataFrame) -> DataFrame:
    """The series less one mean per variable, kept as ``shift``.

    Fourth powers of values far from zero would cancel badly in the fits.
    """
    shifted = attach_group(series, ["variable"], {"shift": F.avg("value")}, measured=False)
    return shifted.withColumn("value", F.col("value") - F.col("shift"))


# ------------------------------------------------------------------ the fits


def aicc(n: Column, rss: Column, parameters: Column | int) -> Column:
    """Small-sample information criterion of a least-squares fit; needs n > k + 1."""
    k = F.lit(parameters) if isinstance(parameters, int) else parameters
    log_lik = -n / 2 * (F.log(F.lit(2 * math.pi) * rss / n) + 1)
    return F.when(n > k + 1, -2 * log_lik + 2 * k + 2 * k * (k + 1) / (n - k - 1))


def fit_baseline(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Intercept-only model: ``n, mean_y, rss, aicc``."""
    sums = events.where(F.col("y").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y"), (F.var_pop("y") * F.count(F.lit(1))).alias("rss")
    )
    n = F.col("n").cast("double")
    return sums.withColumn("aicc", F.when(F.col("rss") > 0, aicc(n, F.col("rss"), BASELINE_PARAMETERS)))


def _fit_columns(df: DataFrame, func: Column, shift: Column | None = None) -> DataFrame:
    """Least squares from the sums ``n, sx..sx4, sy, sy2, sxy, sx2y``, linear or quadratic.

    Coefficients are null for a singular fit. ``shift`` was subtracted from x
    and is put back into the coefficients.
    """
    c = F.col
    n = c("n")
    df = df.withColumns({
        "_xx": c("sx2") - c("sx") * c("sx") / n,
        "_xu": c("sx3") - c("sx") * c("sx2") / n,
        "_uu": c("sx4") - c("sx2") * c("sx2") / n,
        "_xy": c("sxy") - c("sx") * c("sy") / n,
        "_uy": c("sx2y") - c("sx2") * c("sy") / n,
        "_yy": c("sy2") - c("sy") * c("sy") / n,
    })
    quad = func == QUAD
    det = c("_xx") * c("_uu") - c("_xu") * c("_xu")
    solvable = F.when(quad, det > SINGULAR * c("_xx") * c("_uu")).otherwise(F.lit(True)) & (
        c("_xx") > SINGULAR * c("sx2")
    )
    b2 = F.when(quad, F.try_divide(c("_xx") * c("_uy") - c("_xu") * c("_xy"), det))
    b1 = F.when(quad, F.try_divide(c("_uu") * c("_xy") - c("_xu") * c("_uy"), det)).otherwise(
        F.try_divide(c("_xy"), c("_xx"))
    )
    df = df.withColumns({"b2": F.when(solvable, b2), "b1": F.when(solvable, b1)})
    curve = F.coalesce(c("b2"), F.lit(0.0))
    df = df.withColumns({
        "b0": (c("sy") - c("b1") * c("sx") - curve * c("sx2")) / n,
        # An exact fit must not become the logarithm of a rounding error.
        "rss": F.greatest(c("_yy") - c("b1") * c("_xy") - curve * c("_uy"), 1e-15 * c("_yy")),
    })
    df = df.withColumn("rss", F.when(c("b1").isNotNull(), c("rss")))
    df = df.withColumn("r2", F.try_divide(c("_yy") - c("rss"), c("_yy")))
    if shift is not None:
        df = df.withColumns({
            "b0": c("b0") - c("b1") * shift + curve * shift * shift,
            "b1": c("b1") - 2 * curve * shift,
        })
    parameters = F.when(quad, PARAMETERS[QUAD]).otherwise(PARAMETERS[LIN])
    return df.withColumn(
        "aicc", F.when(c("rss") > 0, aicc(n, c("rss"), parameters))
    ).withColumn(
        "delta_aicc",
        c("aicc") - F.when(c("_yy") > 0, aicc(n, c("_yy"), BASELINE_PARAMETERS)),
    ).drop("_xx", "_xu", "_uu", "_xy", "_uy", "_yy")


def window_moments(
    events: DataFrame, series: DataFrame, start: int, stop: int, stats: Sequence[str],
    exclude: tuple[int, int] | None, on: Sequence[str] = (), group: Sequence[str] = (), quad: bool = True,
) -> DataFrame:
    """The nine sums per (group, variable, stat, open, close); one pass for all stats.

    ``shift`` is what ``center_series`` took off the variable, 0 if nothing.
    """
    known = events.where(F.col("y").isNotNull())
    # Counted first, then multiplied.
    slices = pin(event_slices(known, series, start, stop, on), "slices")
    sums = window_sums(slices.withColumn("ys", F.array("y")), start, stop, exclude, stats, quad, group)
    width = start - stop + 1
    return sums.select(
        *group, "variable", "shift", "stat",
        (F.floor(F.col("_window") / width) + stop).cast("int").alias("open"),
        (F.pmod(F.col("_window"), F.lit(width)) + stop).cast("int").alias("close"),
        *MOMENTS, F.get("_sxy", F.lit(0)).alias("sxy"), F.coalesce(F.get("_sx2y", F.lit(0)), F.lit(0.0)).alias("sx2y"),
    )


def scan_windows(
    events: DataFrame,
    series: DataFrame,
    start: int = 120,
    stop: int = -150,
    exclude: tuple[int, int] | None = (10, -150),
    stats: Sequence[str] = (MEAN, SLOPE),
    funcs: Sequence[str] = (LIN, QUAD),
    on: Sequence[str] = (),
    group: Sequence[str] = (),
) -> DataFrame:
    """A fit per window and combination of variable, statistic and function.

    ``delta_aicc`` is relative to the intercept-only model of the same events,
    ``weight`` is each window's share of evidence within its combination, and
    ``rank`` orders the windows of a combination, singular fits last. ``group``
    fits each group of events on its own.
    """
    centered = center_series(series)
    sums = window_moments(events, centered, start, stop, stats, exclude, on, group, QUAD in funcs)
    per_func = sums.withColumn("func", F.explode(F.array(*[F.lit(f) for f in funcs])))
    shift = F.when(F.col("stat") == MEAN, F.col("shift")).otherwise(0.0)
    fitted = _fit_columns(per_func, F.col("func"), shift)
    return rank_windows(_with_weights(fitted, group), group).select(
        *group, *COMBO, "open", "close", F.col("n").cast("long").alias("n"),
        "b0", "b1", "b2", "rss", "r2", "aicc", "delta_aicc", "weight", "rank",
    )


def _with_weights(fitted: DataFrame, group: Sequence[str]) -> DataFrame:
    combo = Window.partitionBy(*group, *COMBO)
    likelihood = F.exp(-(F.col("delta_aicc") - F.min("delta_aicc").over(combo)) / 2)
    return fitted.withColumn("_l", likelihood).withColumn(
        "weight", F.col("_l") / F.sum("_l").over(combo)
    ).drop("_l")


def rank_windows(scan: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """``rank`` 1 is the best window of a combination; the window list bounds the partition."""
    order = Window.partitionBy(*group, *COMBO).orderBy(F.col("delta_aicc").asc_nulls_last(), "open", "close")
    return scan.withColumn("rank", F.row_number().over(order))


def best_windows(scan: DataFrame, n: int = 1) -> DataFrame:
    return scan.where(F.col("rank") <= n)


def delta_surface(scan: DataFrame) -> DataFrame:
    """Criterion per (open, close): the data of a heat map."""
    lead = [c for c in scan.columns[: scan.columns.index("open")]]
    return scan.select(*lead, "open", "close", "delta_aicc")


# ----------------------------------------------------------- after the scan


def confidence_set(scan: DataFrame, level: float = 0.95, group: Sequence[str] = ()) -> DataFrame:
    """The fewest best windows whose weights reach ``level``."""
    ranked = cumulative_weight(scan.where(F.col("weight").isNotNull()), "weight", [*group, *COMBO], ["rank"])
    return ranked.where(F.col("cum_weight") - F.col("weight") < level)


def average_models(windows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Weight-averaged coefficients and the median open and close of a set of windows."""
    keys = [*group, *COMBO]
    return windows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"),
        *[weighted_mean(b, "weight").alias(b) for b in ("b0", "b1", "b2")],
        # Integers of a few hundred values, so the exact median is cheap.
        F.median("open").alias("median_open"),
        F.median("close").alias("median_close"),
    )


def window_spread(windows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Five-number summary of open and close in a set of windows."""
    ends = windows.withColumn(
        "_end",
        F.explode(F.array(
            F.struct(F.lit("open").alias("end"), F.col("open").alias("offset")),
            F.struct(F.lit("close").alias("end"), F.col("close").alias("offset")),
        )),
    ).select(*group, *COMBO, "_end.*")
    return five_numbers(ends, [*group, *COMBO, "end"], "offset")


def best_model_data(
    scan: DataFrame, events: DataFrame, series: DataFrame, start: int, stop: int,
    on: Sequence[str] = (), group: Sequence[str] = (), z: float = NORMAL_95,
) -> DataFrame:
    """Climate value, response, fit and interval per event in each combination's best window."""
    best = best_windows(scan).select(*group, *COMBO, "open", "close", "n", "b0", "b1", "b2", "rss")
    slices = event_slices(events.where(F.col("y").isNotNull()), series, start, stop, on)
    joined = join_on(slices, best, [*group, "variable"])
    climate = F.when(F.col("stat") == MEAN, window_value(MEAN, start)).otherwise(window_value(SLOPE, start))
    data = joined.withColumn("climate", climate).select(
        *group, *COMBO, "event_id", "open", "close", "climate", F.col("y").alias("yvar"),
        "n", "b0", "b1", "b2", "rss",
    )
    return _with_interval(data, data, [*group, *COMBO], z).drop("n", "b0", "b1", "b2", "rss")


def predict_curve(
    best_data: DataFrame, scan: DataFrame, step: float = 0.1, group: Sequence[str] = (), z: float = NORMAL_95
) -> DataFrame:
    """The best model over the range of its climate values, with se and interval."""
    keys = [*group, *COMBO]
    best = best_windows(scan).select(*keys, "n", "b0", "b1", "b2", "rss")
    ranges = best_data.groupBy(*keys).agg(F.min("climate").alias("_low"), F.max("climate").alias("_high"))
    grid = decimal_spine(attach(ranges, best, keys, "inner"), "_low", "_high", step, "climate")
    return _with_interval(grid, best_data, keys, z).drop("n", "b0", "b1", "b2", "rss", "_low", "_high")


def _with_interval(points: DataFrame, data: DataFrame, keys: Sequence[str], z: float) -> DataFrame:
    """Add ``pred, se, LCI, UCI`` at ``climate`` for models fitted to ``data``."""
    sizes = data.groupBy(*keys).agg(F.avg("climate").alias("_mid"))
    offsets = attach(data.select(*keys, "climate"), sizes, keys).withColumn("_x", F.col("climate") - F.col("_mid"))
    x = F.col("_x")
    sums = offsets.groupBy(*keys).agg(
        F.min("_mid").alias("_mid"), F.sum(x * x).alias("_s2"),
        F.sum(x * x * x).alias("_s3"), F.sum(x * x * x * x).alias("_s4"),
    )
    df = attach(points, sums, keys)
    x, u, n = F.col("climate"), F.col("climate") - F.col("_mid"), F.col("n").cast("double")
    quad = F.col("func") == QUAD
    # Leverage in x and the part of x squared that x does not explain.
    ratio = F.try_divide("_s3", "_s2")
    rest = u * u - F.col("_s2") / n - ratio * u
    rest_ss = F.col("_s4") - F.col("_s2") * F.col("_s2") / n - F.col("_s3") * ratio
    leverage = 1 / n + F.try_divide(u * u, F.col("_s2")) + F.when(quad, F.try_divide(rest * rest, rest_ss)).otherwise(0.0)
    free = n - F.when(quad, 3).otherwise(2)
    df = df.withColumn(
        "pred", F.col("b0") + F.col("b1") * x + F.coalesce(F.col("b2"), F.lit(0.0)) * x * x
    ).withColumn("se", F.sqrt(F.try_divide(F.col("rss"), free) * leverage))
    low, high = normal_interval("pred", "se", z)
    return df.withColumns({"LCI": low, "UCI": high}).drop("_mid", "_s2", "_s3", "_s4")


def null_histogram(
    rand: DataFrame, bins: int, scan: DataFrame | None = None, low: float | None = None, high: float | None = None, group: Sequence[str] = ()
) -> DataFrame:
    """Histogram of the best criteria under shuffled responses; with ``scan`` also the ``observed`` best, the line to draw in it.

    Without limits the bins reach from the whole number below the least value to that above the greatest.
    """
    keys = [*group, *COMBO]
    if low is None or high is None:
        ends = rand.agg(F.floor(F.min("delta_aicc")), F.ceil(F.max("delta_aicc"))).first()
        low, high = low if low is not None else float(ends[0] or 0), high if high is not None else float(ends[1] or 0)
    counts = histogram(rand, "delta_aicc", low, high, bins, keys)
    if scan is None:
        return counts
    return attach(counts, best_windows(scan).select(*keys, F.col("delta_aicc").alias("observed")), keys)
