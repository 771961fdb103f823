"""Operators over ordered rows of a group: counters, running sums, gap filling.

Order is always explicit and must be unique within the keys. With ``span=None``
a group is one window partition; that fits groups that the calendar bounds,
such as a daily series with one row per date. ``span`` handles groups without a
bound: the first order column is cut into chunks of that width (days for dates,
seconds for timestamps, units for numbers), rows are processed per (keys,
chunk), and only one summary row per chunk is carried along the group. A hot
group thus spreads over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonwin.operators.joins import attach, attach_group

_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)
_SO_FAR = (Window.unboundedPreceding, 0)
_BEFORE = (Window.unboundedPreceding, -1)


def chunk_of(df: DataFrame, order: str, span: float) -> Column:
    """Number of the ``span``-wide chunk of an order column; grows with the order."""
    kind = df.schema[order].dataType
    c = F.col(order)
    if isinstance(kind, T.DateType):
        c = F.unix_date(c)
    elif isinstance(kind, T.TimestampNTZType):
        c = F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    elif isinstance(kind, T.TimestampType):
        c = F.unix_micros(c) / F.lit(1e6)
    return F.floor(c / F.lit(span)).cast("long")


Merges = Mapping[str, tuple[Column, Callable[[Column], Column]]]


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    forward: Merges | None = None,
    backward: Merges | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """Running aggregates ``{name: (input, fn)}`` including each row, from either end.

    ``fn`` must be an aggregate that merges with itself, such as ``F.sum`` or
    ``F.max``; it ignores missing values. All of them share one shuffle of the
    rows; with ``chunk`` a summary row per chunk carries the rest.
    """
    ways = {n: (c, fn, False) for n, (c, fn) in (forward or {}).items()}
    ways |= {n: (c, fn, True) for n, (c, fn) in (backward or {}).items()}
    inputs = {f"_in_{n}": way[0] for n, way in ways.items()}
    if chunk is None:
        return _both_ways(df.withColumns(inputs), keys, order, ways, "").drop(*inputs)

    # The struct is the one partitioning key of the window and of the join.
    part = F.struct(*[F.col(k) for k in keys], chunk.alias("_chunk"))
    rows = df.withColumns({**inputs, "_part": part})
    totals = rows.groupBy("_part").agg(*[fn(F.col(f"_in_{n}")).alias(f"_sum_{n}") for n, (_, fn, _) in ways.items()])
    along = Window.partitionBy(*[F.col(f"_part.{k}") for k in keys])
    at = F.col("_part._chunk")
    carry = totals.select("_part", *[
        fn(F.col(f"_sum_{n}")).over(along.orderBy(at.desc() if back else at).rowsBetween(*_BEFORE)).alias(f"_carry_{n}")
        for n, (_, fn, back) in ways.items()
    ])
    local = _both_ways(rows, ["_part"], order, ways, "_local_")
    out = {n: _merge(fn, F.col(f"_carry_{n}"), F.col(f"_local_{n}")) for n, (_, fn, _) in ways.items()}
    helpers = [f"{p}{n}" for n in ways for p in ("_in_", "_carry_", "_local_")]
    return local.join(carry, "_part").withColumns(out).drop("_part", *helpers)


def _both_ways(rows: DataFrame, part: Sequence[str], order: Sequence[str], ways: Mapping, prefix: str) -> DataFrame:
    """Running aggregates of the inputs ``_in_*`` within a window partition.

    A frame that ends with the partition is added up anew for every row, which takes the square of the partition's
    rows. From the end, sums of whole numbers are thus the total less what comes before; other aggregates run over
    the rows in reverse, by row number, so that equal ones are reversed, too.
    """
    up = Window.partitionBy(*part).orderBy(*order)
    down = Window.partitionBy(*part).orderBy(F.col("_row").desc())
    out, reverse = {}, {}
    for n, (_, fn, back) in ways.items():
        field = rows.schema[f"_in_{n}"]
        c = F.col(f"_in_{n}")
        so_far = fn(c).over(up.rowsBetween(*_SO_FAR))
        if not back:
            out[f"{prefix}{n}"] = so_far
        elif fn is F.sum and isinstance(field.dataType, T.LongType) and not field.nullable:
            out[f"{prefix}{n}"] = fn(c).over(up.rowsBetween(*_ALL)) - so_far + c
        else:
            reverse[f"{prefix}{n}"] = fn(c).over(down.rowsBetween(*_SO_FAR))
    if not reverse:
        return rows.withColumns(out)
    return rows.withColumns({**out, "_row": F.row_number().over(up)}).withColumns(reverse).drop("_row")


def _merge(fn: Callable, a: Column, b: Column) -> Column:
    if fn is F.sum:
        both = a + b
    elif fn is F.max:
        both = F.greatest(a, b)
    elif fn is F.min:
        both = F.least(a, b)
    else:
        raise ValueError("chunked running aggregates are sum, max or min")
    return F.coalesce(both, a, b)


def _chunk(df: DataFrame, order: Sequence[str], span: float | None) -> Column | None:
    return None if span is None else chunk_of(df, order[0], span)


def count_up(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "n_up",
             span: float | None = None) -> DataFrame:
    """Row number 1..n in order."""
    return running(df, keys, order, {out: (F.lit(1).cast("long"), F.sum)}, chunk=_chunk(df, order, span))


def count_down(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "n_down",
               span: float | None = None) -> DataFrame:
    """Rows left including this one: n..1 in order."""
    return running(df, keys, order, None, {out: (F.lit(1).cast("long"), F.sum)}, _chunk(df, order, span))


def count_both(df: DataFrame, keys: Sequence[str], order: Sequence[str], up: str = "n_up", down: str = "n_down",
               span: float | None = None) -> DataFrame:
    """Both counters in one pass."""
    one = (F.lit(1).cast("long"), F.sum)
    return running(df, keys, order, {up: one}, {down: one}, _chunk(df, order, span))


def running_sum(df: DataFrame, c: str, keys: Sequence[str], order: Sequence[str], out: str,
                sticky: bool = True, span: float | None = None) -> DataFrame:
    """Running sum; with ``sticky`` it stays missing from the first missing value on."""
    merges = {
        "_total": (F.col(c), F.sum),
        "_unknown": (F.col(c).isNull().cast("long"), F.sum),
    }
    summed = running(df, keys, order, merges, chunk=_chunk(df, order, span))
    value = F.when(F.col("_unknown") == 0, F.col("_total")) if sticky else F.col("_total")
    return summed.withColumn(out, value).drop("_total", "_unknown")


def cumulative_weight(df: DataFrame, weight: str, keys: Sequence[str], ties: Sequence[str],
                      out: str = "cum_weight") -> DataFrame:
    """Running weight from the heaviest row down; ``ties`` make the order unique."""
    w = Window.partitionBy(*keys).orderBy(F.col(weight).desc_nulls_last(), *ties).rowsBetween(*_SO_FAR)
    return df.withColumn(out, F.sum(weight).over(w))


def rolling_agg(
    df: DataFrame,
    c: str,
    width: int,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    fn: Callable[[Column], Column] = F.sum,
    sticky: bool = True,
    span: float | None = None,
    rows_per_chunk: int = 100_000,
) -> DataFrame:
    """Aggregate of the last ``width`` rows, fewer at the start of a group.

    With ``sticky`` a missing value in the frame makes the result missing. Any
    native aggregate serves as ``fn``. With ``span`` the rows are numbered first
    and recut into chunks of equal row count, each given the ``width - 1`` rows
    before it as well.
    """
    def roll(rows: DataFrame, w) -> DataFrame:
        value = fn(F.col(c)).over(w)
        if sticky:
            value = F.when(F.count_if(F.col(c).isNull()).over(w) == 0, value)
        return rows.withColumn(out, value)

    if span is None:
        return roll(df, Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(width - 1), 0))
    size = max(rows_per_chunk, width)
    numbered = count_up(df, keys, order, "_rn", span)
    home = F.floor((F.col("_rn") - 1) / size)
    reach = F.floor((F.col("_rn") - 1 + width - 1) / size)
    spread = numbered.withColumn("_home", home).withColumn("_to", F.explode(F.sequence(home, reach)))
    w = Window.partitionBy(*keys, "_to").orderBy("_rn").rowsBetween(-(width - 1), 0)
    return roll(spread, w).where(F.col("_to") == F.col("_home")).drop("_rn", "_home", "_to")


def first_in_group(df: DataFrame, c: str, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """The value on the group's first row, missing if it is missing there."""
    return attach_group(df, keys, {out: F.min_by(c, F.struct(*[F.col(o) for o in order]))})


def center(df: DataFrame, c: str, keys: Sequence[str], out: str) -> DataFrame:
    """The value less its group mean."""
    return attach_group(df, keys, {"_mean": F.avg(c)}).withColumn(out, F.col(c) - F.col("_mean")).drop("_mean")


def value_before_peak(df: DataFrame, c: str, peak: str, keys: Sequence[str], order: Sequence[str], out: str,
                      span: float | None = None) -> DataFrame:
    """The value on the row before the first maximum of ``peak``, on all rows of the group.

    Each chunk of a group leaves one row: its first maximum, the value before that, and its last value,
    which is what stands before the next chunk's first row.
    """
    chunk = _chunk(df, order, span)
    part = [*keys, "_chunk"]
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.select(
        *keys, (F.lit(0) if chunk is None else chunk).alias("_chunk"), *[F.col(o).alias(n) for o, n in zip(order, names)],
        F.col(peak).alias("_peak"), F.col(c).alias("_value"),
    )
    within = Window.partitionBy(*part).orderBy(*names)
    rows = rows.withColumns({"_before": F.lag("_value").over(within), "_first": F.row_number().over(within) == 1})
    top = F.min(F.when(F.col("_peak").isNotNull(), F.struct((-F.col("_peak")).alias("peak"), *names, "_first", "_before")))
    chunks = rows.groupBy(*part).agg(top.alias("_top"), F.max(F.struct(*names, "_value")).alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_chunk")
    chunks = chunks.withColumn("_carry", F.lag("_last._value").over(along)).where("_top is not null")
    value = F.when(F.col("_top._first"), F.col("_carry")).otherwise(F.col("_top._before"))
    best = chunks.groupBy(*keys).agg(F.min(F.struct("_top.peak", *[f"_top.{n}" for n in names], value.alias("value"))).alias("_best"))
    return attach(df, best.select(*keys, F.col("_best.value").alias(out)), keys, measured=True)


def argmax_rows(df: DataFrame, c: str, keys: Sequence[str], ties: Sequence[Column]) -> DataFrame:
    """One whole row per group: the maximum of ``c``, ties to the largest ``ties``."""
    rank = F.when(F.col(c).isNotNull(), F.struct(F.col(c), *ties))
    rest = [x for x in df.columns if x not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(x) for x in rest]), rank).alias("_row"))
    return best.select(*keys, *[F.col("_row")[x].alias(x) for x in rest])


def interpolate_linear(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    order: Sequence[str],
    max_gap: int | None = None,
    x: str | None = None,
    span: float | None = None,
) -> DataFrame:
    """Fill gaps on the line between the nearest known neighbours of the same group.

    Position is the row number, or the number or date in ``x``. Gaps of more
    than ``max_gap`` rows and the ends of a group stay missing.
    """
    numbered = count_up(df, keys, order, "_rn", span)
    at = F.col("_rn") if x is None else (
        F.unix_date(x) if isinstance(df.schema[x].dataType, T.DateType) else F.col(x)
    )
    numbered = numbered.withColumn("_at", at.cast("double"))

    # Structs compare by row number first: the largest so far is the last known row.
    def known(c: str) -> Column:
        return F.when(F.col(f"`{c}`").isNotNull(), F.struct("_rn", "_at", F.col(f"`{c}`").cast("double").alias("v")))

    both = running(
        numbered, keys, order,
        {f"_prev_{i}": (known(c), F.max) for i, c in enumerate(cols)},
        {f"_next_{i}": (known(c), F.min) for i, c in enumerate(cols)},
        _chunk(numbered, order, span),
    )
    filled = {}
    for i, c in enumerate(cols):
        a, b = F.col(f"_prev_{i}"), F.col(f"_next_{i}")
        line = a["v"] + (b["v"] - a["v"]) * (F.col("_at") - a["_at"]) / (b["_at"] - a["_at"])
        short = F.lit(True) if max_gap is None else (b["_rn"] - a["_rn"] - 1) <= max_gap
        filled[c] = F.when(F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`")).when(short, line)
    helpers = [f"{p}{i}" for i in range(len(cols)) for p in ("_prev_", "_next_")]
    return both.withColumns(filled).drop("_rn", "_at", *helpers)


def fill_neighbours(df: DataFrame, c: str, keys: Sequence[str], date: str, k: int = 2) -> DataFrame:
    """A missing day becomes the mean of the known days up to ``k`` before and after it.

    Neighbours are calendar days, so missing rows do not widen the reach.
    """
    near = Window.partitionBy(*keys).orderBy(F.unix_date(date)).rangeBetween(-k, k)
    return df.withColumn(c, F.coalesce(F.col(c), F.avg(c).over(near)))
