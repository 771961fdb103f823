"""Keyed, interval and before/after-event joins.

Which side to broadcast is left to the planner, which knows sizes: a lookup
computed from other tables is first written to the shared folder (``pin``), so
that a small one is broadcast and the rows it is attached to are not shuffled
at all. A large one gives a sort-merge join, whose hot keys adaptive execution
splits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonwin.functions.columns import day_number
from seasonwin.session import pin


def join_on(left: DataFrame, right: DataFrame, keys: Mapping[str, str] | Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on equally or differently named keys; the left names stay."""
    names = dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}
    renamed = right.withColumnsRenamed({r: f"_right_{r}" for r in names.values()})
    match = reduce(lambda a, b: a & b, [left[k] == renamed[f"_right_{r}"] for k, r in names.items()])
    return left.join(renamed, match, how).drop(*[f"_right_{r}" for r in names.values()])


def attach(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", measured: bool = False
) -> DataFrame:
    """Look up ``right``'s columns by ``keys``, matching missing keys with each other.

    ``measured`` computes ``right`` first, so that its true size picks the join.
    Keys are packed in one struct: struct equality treats two missing fields as
    equal, and remains a plain equi-join that a hash partitioning can serve.
    """
    packed = F.struct(*([F.col(k) for k in keys] or [F.lit(0)]))
    values = [c for c in right.columns if c not in keys]
    if measured and keys:
        right = pin(right, "lookup")
    lookup = right.select(packed.alias("_key"), *values)
    if not keys:
        # Aggregated over no keys, hence exactly one row.
        lookup = F.broadcast(lookup)
    return left.withColumn("_key", packed).join(lookup, "_key", how).drop("_key")


def attach_group(
    df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column], measured: bool = True
) -> DataFrame:
    """Add group aggregates to each row.

    Aggregating before joining back combines on the map side, so a group holding
    most of the rows costs one partial row per task; a window over the group
    would pull all its rows into one task. With few groups the rows then meet a
    broadcast table and are never shuffled.
    """
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return attach(df, totals, keys, measured=measured)


def fill_from(df: DataFrame, lookup: DataFrame, on: Mapping[str, str], fills: Mapping[str, str]) -> DataFrame:
    """Fill missing values of ``df`` from ``lookup``, matched by key (one row per key).

    ``on`` and ``fills`` map a column of ``df`` to a column of ``lookup``.
    """
    source = lookup.select(
        *[F.col(r).alias(r) for r in on.values()],
        *[F.col(s).alias(f"_fill_{c}") for c, s in fills.items()],
    )
    joined = join_on(df, pin(source, "lookup"), on, "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"_fill_{c}")) for c in fills}
    return joined.withColumns(filled).drop(*[f"_fill_{c}" for c in fills])


def semi_in(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other``."""
    keys = other.select(F.col(other_key or key).alias(key)).distinct()
    return df.join(pin(keys, "keys"), key, "left_semi")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    date: str,
    on: str,
    off: str,
    pad: int = 0,
    bucket_days: int = 32,
) -> DataFrame:
    """Points with each interval ``[on - pad, off + pad]`` that holds their date.

    Both sides are cut into buckets of days, which makes this an equi-join on
    (keys, bucket) even without keys: a hot key is spread over time, and points
    meet only the intervals alive in their own bucket.
    """
    def bucket(d: Column) -> Column:
        return F.floor(day_number(d) / bucket_days).cast("int")

    low, high = F.date_sub(F.col(on), pad), F.date_add(F.col(off), pad)
    spans = intervals.where(low <= high).withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    tagged = points.withColumn("_bucket", bucket(F.col(date)))
    joined = tagged.join(spans, [*keys, "_bucket"])
    return joined.where((F.col(date) >= low) & (F.col(date) <= high)).drop("_bucket")


def relative_series(
    events: DataFrame,
    series: DataFrame,
    start: int,
    stop: int,
    on: Sequence[str] = (),
) -> DataFrame:
    """Daily values ``start`` days before to ``stop`` (negative: after) around each event.

    ``events`` has ``bdate``; ``series`` is a complete daily series per
    (``on``, ``variable``) with ``date, value``. Gives one row per event,
    variable and ``offset`` in days before the event.
    """
    from seasonwin.operators.scan import event_slices

    slices = event_slices(events, series, start, stop, on, ("value",))
    return (
        slices.select("*", F.posexplode("value").alias("_i", "_v"))
        .withColumn("offset", F.lit(start) - F.col("_i"))
        .withColumn("value", F.col("_v"))
        .drop("_i", "_v")
    )
