"""Row and column reshaping."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonwin.functions.columns import col, parse_date
from seasonwin.operators.joins import attach_group

_COPIES_PER_ARRAY = 10_000


def across(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply a column function to several columns in one projection."""
    return df.withColumns({c: fn(F.col(f"`{c}`")) for c in cols})


def parse_dates(
    df: DataFrame, cols: Sequence[str] | None = None, suffix: str | None = None, fmt: str = "M/d/y"
) -> DataFrame:
    """Turn text columns, named or picked by ``suffix``, into dates."""
    picked = list(cols or []) + [c for c in df.columns if suffix and c.endswith(suffix)]
    return across(df, picked, lambda c: parse_date(c, fmt))


def uncount(df: DataFrame, count: str) -> DataFrame:
    """Repeat each row ``count`` times and drop the count; 0 or missing drops the row.

    The copies are made in two steps, so that a huge count never becomes one huge array.
    """
    n = F.col(count).cast("long")
    blocks = F.ceil(n / F.lit(_COPIES_PER_ARRAY)).cast("int")
    size = F.least(F.lit(_COPIES_PER_ARRAY).cast("long"), n - F.col("_block") * _COPIES_PER_ARRAY)
    return (
        df.where(n > 0)
        .withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), size.cast("int"))))
        .drop("_block", "_copy", count)
    )


def filter_near_group_mean(df: DataFrame, keys: Sequence[str], c: str, radius: float) -> DataFrame:
    """Rows strictly closer than ``radius`` to their group's mean (mean before filtering)."""
    return (
        attach_group(df, keys, {"_mean": F.avg(c)})
        .where(F.abs(F.col("_mean") - F.col(c)) < radius)
        .drop("_mean")
    )


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def keep_missing(df: DataFrame, c: str) -> DataFrame:
    return df.where(F.col(c).isNull())


def select_except(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All columns but ``cols``, picked by name."""
    return df.drop(*cols)


def expand_seq(df: DataFrame, keys: Sequence[str], low: Column, high: Column, out: str) -> DataFrame:
    """One row per group and integer from ``low`` to ``high`` (aggregates of the group)."""
    bounds = df.groupBy(*keys).agg(low.cast("int").alias("_low"), high.cast("int").alias("_high"))
    return bounds.select(*keys, F.explode(F.sequence("_low", "_high")).alias(out))


def date_spine(df: DataFrame, keys: Sequence[str], date: str, out: str = "date") -> DataFrame:
    """Every calendar day between a group's first and last date."""
    bounds = df.groupBy(*keys).agg(F.min(date).alias("_low"), F.max(date).alias("_high"))
    return bounds.select(*keys, F.explode(F.sequence("_low", "_high")).alias(out))


def decimal_spine(df: DataFrame, low: str, high: str, step: float, out: str) -> DataFrame:
    """Each row repeated for ``low, low + step, ...`` not beyond ``high``."""
    # The tolerance keeps an end point that the division misses by a rounding error.
    steps = F.floor((col(high) - col(low)) / step + 1e-9).cast("int")
    spine = df.where(steps >= 0).withColumn("_i", F.explode(F.sequence(F.lit(0), steps)))
    return spine.withColumn(out, col(low) + F.col("_i") * F.lit(step)).drop("_i")


def expand_grid(df: DataFrame, **values: Sequence) -> DataFrame:
    """Each row of ``df`` with every combination of the literal ``values``."""
    for name, options in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in options])))
    return df
