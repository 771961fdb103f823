"""Grouped summaries; all combine on the map side before they shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonwin.functions.columns import col, day_number
from seasonwin.operators.joins import attach
from seasonwin.operators.ordered import running
from seasonwin.session import pin

_SKETCH_ACCURACY = 10_000
_BRACKET_CHUNKS = 1024
# How far around a wanted rank a bracket reaches at first, as a share of the rows.
_FIRST_SLACK = 2.0 / _SKETCH_ACCURACY


def group_counts(df: DataFrame, keys: Sequence[str], condition: Column, total: str = "Total",
                 hits: str = "Females", share: str = "PropFemale") -> DataFrame:
    """Rows, rows meeting ``condition`` (missing does not count) and their share."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(total),
        F.count_if(condition).alias(hits),
        (F.count_if(condition) / F.count(F.lit(1))).alias(share),
    )


def padded_range(df: DataFrame, keys: Sequence[str], c: str, pad: int) -> DataFrame:
    return df.groupBy(*keys).agg((F.min(c) - pad).alias("first"), (F.max(c) + pad).alias("last"))


def coverage(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """Share of rows whose value is known, per group."""
    return df.groupBy(*keys).agg((F.count(c) / F.count(F.lit(1))).alias("coverage"))


def daily_means(
    df: DataFrame, date: str, means: Mapping[str, str], mid: Mapping[str, tuple[str, str]] | None = None,
    count: tuple[str, str] | None = None, keys: Sequence[str] = (),
) -> DataFrame:
    """Daily mean over stations, skipping missing values.

    ``means`` maps output to input column, ``mid`` an output to the two outputs
    it is midway between, ``count`` is (output, input) for a count of known values.
    """
    aggregates = [F.avg(c).alias(out) for out, c in means.items()]
    aggregates += [
        ((F.avg(means[a]) + F.avg(means[b])) / 2).alias(out) for out, (a, b) in (mid or {}).items()
    ]
    if count:
        aggregates.append(F.count(count[1]).alias(count[0]))
    return df.groupBy(*keys, date).agg(*aggregates)


def mean_date(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Mean calendar date: ``mean_day`` keeps the fraction, ``mean_date`` drops it."""
    days = df.groupBy(*keys).agg(F.avg(day_number(date)).alias("mean_day"))
    return days.withColumn("mean_date", F.date_from_unix_date(F.floor("mean_day").cast("int")))


def row_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def missing_counts(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Known (``n_``) and missing (``missing_``) values per column."""
    aggregates = []
    for c in cols:
        aggregates += [F.count(c).alias(f"n_{c}"), F.count_if(F.col(c).isNull()).alias(f"missing_{c}")]
    return df.groupBy(*keys).agg(*aggregates)


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Aggregate: weighted mean over rows where both are known."""
    v, w = col(value), col(weight)
    known = v.isNotNull() & w.isNotNull()
    return F.try_divide(F.sum(F.when(known, v * w)), F.sum(F.when(known, w)))


def moments(x: Column | str, y: Column | str) -> dict[str, Column]:
    """Aggregates that a linear or quadratic least-squares fit of y on x needs."""
    x, y = col(x).cast("double"), col(y).cast("double")
    known = x.isNotNull() & y.isNotNull()
    terms = {
        "n": F.lit(1.0), "sx": x, "sx2": x * x, "sx3": x * x * x, "sx4": x * x * x * x,
        "sy": y, "sy2": y * y, "sxy": x * y, "sx2y": x * x * y,
    }
    return {name: F.sum(F.when(known, term)).alias(name) for name, term in terms.items()}


def histogram(df: DataFrame, c: str, low: float, high: float, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per equal bin of ``[low, high]``; the last bin includes ``high``.

    What lies below is counted in bin -1, what lies above in bin ``bins``; these have no outer edge.
    Missing values are not counted.
    """
    width = (high - low) / bins
    value = F.col(c)
    inner = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(bins - 1)
    bin_ = F.when(value < low, -1).when(value > high, bins).otherwise(inner).cast("long")
    at = F.col("bin")
    return df.where(value.isNotNull()).groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumns({
        "low": F.when(at >= 0, F.lit(low) + at * width), "high": F.when(at < bins, F.lit(low) + (at + 1) * width)
    })


def quantiles(df: DataFrame, keys: Sequence[str], c: str, probs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles: ``(keys, prob, quantile)``.

    Spark's exact percentile keeps every distinct value of a group in one task.
    Here a mergeable sketch brackets each wanted rank, values below the bracket
    are only counted, and those inside are ranked exactly by (value, count), in
    chunks of the bracket's width. The counts tell whether a rank is inside; if one
    isn't, all brackets are made ten times as wide, up to the whole range.
    """
    known = df.where(F.col(c).isNotNull()).select(*keys, F.col(c).cast("double").alias("_v"))
    slack = _FIRST_SLACK
    while True:
        counted = _counted(known, keys, probs, slack)
        group = [*keys, "prob", "rank"]
        found = counted.groupBy(*group).agg(
            F.sum(F.when(F.col("_v").isNull(), F.col("_m")).otherwise(0)).alias("_low"), F.sum("_m").alias("_high")
        )
        outside = (F.col("_low") > F.floor("rank")) | (F.col("_high") <= F.ceil("rank"))
        if slack >= 1 or found.where(outside).isEmpty():
            break
        slack *= 10
    return _interpolated(counted, keys)


def _counted(known: DataFrame, keys: Sequence[str], probs: Sequence[float], slack: float) -> DataFrame:
    """How often each value inside a bracket occurs, and, under the missing value, how many lie below it."""
    edges = F.array(*[F.struct(F.lit(float(p)).alias("prob"), *_bracket(p, slack)) for p in probs])
    brackets = (
        known.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), edges.alias("_edges"))
        .withColumn("_edges", F.transform("_edges", lambda e: e.withField("rank", e["prob"] * (F.col("_n") - 1))))
        .drop("_n")
    )
    tagged = (
        attach(known, brackets, keys, measured=True)
        .select(*keys, "_v", F.explode("_edges").alias("_e"))
        .select(*keys, "_v", "_e.*")
        .where(F.col("_v") <= F.col("above"))
    )
    inside = F.when(F.col("_v") >= F.col("below"), F.col("_v"))
    group = [*keys, "prob", "rank", "below", "above"]
    counted = tagged.groupBy(*group, inside.alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    # Few rows next to the table's; they are checked, then the running sum reads them twice.
    return pin(counted, "counted")


def _interpolated(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    group = [*keys, "prob", "rank", "below", "above"]
    share = F.try_divide(F.col("_v") - F.col("below"), F.col("above") - F.col("below"))
    chunk = F.coalesce(F.floor(share * _BRACKET_CHUNKS), F.when(F.col("_v").isNull(), -1).otherwise(0)).cast("long")
    ranked = running(counted, group, ["_v"], {"_upto": (F.col("_m"), F.sum)}, chunk=chunk)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_m") <= rank) & (rank < F.col("_upto")), F.col("_v")))

    low = F.floor("rank")
    ends = ranked.groupBy(*keys, "prob", "rank").agg(at(low).alias("_lo"), at(F.ceil("rank")).alias("_hi"))
    between = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("rank") - low)
    return ends.select(*keys, "prob", between.alias("quantile"))


def _bracket(prob: float, slack: float) -> list[Column]:
    """Two values that should enclose the wanted rank.

    The sketch's rank error is at most 1/accuracy. Twice that either way covers
    it once a group is large; a small group is its own bracket.
    """
    small = F.count(F.lit(1)) < 5 * _SKETCH_ACCURACY
    low, high = F.min("_v"), F.max("_v")
    below = F.percentile_approx("_v", prob - slack, _SKETCH_ACCURACY) if prob > slack else low
    above = F.percentile_approx("_v", prob + slack, _SKETCH_ACCURACY) if prob + slack < 1 else high
    return [F.when(small, low).otherwise(below).alias("below"), F.when(small, high).otherwise(above).alias("above")]


def five_numbers(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """Minimum, quartiles, mean and maximum per group."""
    quartile = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    wide = quantiles(df, keys, c, list(quartile)).groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in quartile.items()]
    )
    ends = df.groupBy(*keys).agg(F.min(c).alias("min"), F.avg(c).alias("mean"), F.max(c).alias("max"))
    return attach(ends, wide, keys)


def medians(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    return quantiles(df, keys, c, [0.5]).select(*keys, F.col("quantile").alias("median"))
