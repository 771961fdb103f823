"""Sums over events per window, by matrix products in Arrow batches.

One event has tens of thousands of windows. Making a row of each pair would
cost a hundred times the arithmetic, so a task takes events as a matrix, a bounded number at a
time, and keeps one array of sums for them all. These are merged by window block: what is
shuffled grows with the tasks, not with the events.

A window's mean or slope is a difference of running sums, so its product with a
response is the same difference of the running sums' products: these cost one column per day, not per window.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seasonwin.operators.joins import attach
from seasonwin.operators.partials import lists_of, matrix_of

# Send the function that runs in tasks with its code, so that executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEAN, SLOPE = "mean", "slope"
MOMENTS = ("n", "sx", "sx2", "sx3", "sx4", "sy", "sy2")
_EVENTS_AT_A_TIME = 1024
# Windows are dealt to this many blocks: few rows of work then fill many cores,
# and a block bounds the memory of a product.
_BLOCKS = 16


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Few small rows that each stand for much work, one share per core.

    The number is explicit: adaptive execution goes by bytes and would put them
    all into one task.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys)


def window_sums(
    slices: DataFrame, start: int, stop: int, exclude: tuple[int, int] | None, stats: Sequence[str], quad: bool,
    group: Sequence[str] = (), sized: DataFrame | None = None,
) -> DataFrame:
    """The sums of a linear or quadratic fit per (group, variable, stat, window).

    ``slices`` holds each event's stretch of the series, its response ``y`` and
    the list ``ys`` of responses to multiply with. ``_window`` numbers the pair
    (open, close); ``_sxy`` and ``_sx2y`` hold one element per element of
    ``ys``. ``sized``, if given, is a cheaper table with the same events.
    """
    keys = [*group, "variable"]
    cores = slices.sparkSession.sparkContext.defaultParallelism
    # A group is dealt to as many chunks as it can fill, at most one per core.
    chunks = F.least(F.lit(cores), F.ceil(F.col("_m") / F.lit(_EVENTS_AT_A_TIME))).cast("long")
    sizes = (slices if sized is None else sized).groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    total = sizes.agg(F.sum(chunks).alias("chunks"), F.max(chunks).alias("most")).first()
    # Copies of the events share the blocks of windows, to occupy cores that chunks leave idle.
    copies = min(_BLOCKS, max(1, -(-4 * cores // (total["chunks"] or 1))))
    work = (
        attach(slices, sizes, keys)
        .withColumn("_chunk", F.pmod(F.xxhash64("event_id"), chunks))
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    )
    unit = [*keys, "shift", "_chunk", "_copy"]
    fields = [f for f in work.schema.fields if f.name in (*keys, "shift")]
    names = [f.name for f in fields]
    windows = _Windows(start, stop, exclude)
    # Events of a chunk meet in one task per copy, one batch after the other; hashing unique ids keeps chunks even.
    dealt = spread(work.select(*unit, "sums", "tsums", "base", "y", "ys"), *unit).sortWithinPartitions(*unit)
    blocks = T.StructType([*fields, T.StructField("stat", T.StringType()), T.StructField("_block", T.IntegerType()), T.StructField("_r", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    kinds = to_arrow_schema(blocks)
    sums = dealt.mapInArrow(_products(len(names), windows, list(stats), quad, copies, kinds), blocks)
    if (total["most"] or 0) > 1:
        whole = [*names, "stat", "_block", "_r"]
        sums = spread(sums, *whole).sortWithinPartitions(*whole).mapInArrow(_merged(len(whole), kinds), blocks)
    schema = _sums_schema(fields)
    return sums.mapInArrow(_unfolded(len(names), windows, quad, to_arrow_schema(schema)), schema)


def _sums_schema(fields: list[T.StructField]) -> T.StructType:
    array = T.ArrayType(T.DoubleType())
    return T.StructType([
        *fields, T.StructField("stat", T.StringType()), T.StructField("_window", T.IntegerType()),
        *[T.StructField(m, T.DoubleType()) for m in MOMENTS],
        T.StructField("_sxy", array), T.StructField("_sx2y", array),
    ])


class _Windows:
    """The windows of a scan, by blocks that are dealt by their open."""

    def __init__(self, start: int, stop: int, exclude: tuple[int, int] | None):
        self.width, self.stop, self.exclude = start - stop + 1, stop, exclude

    def of(self, block: int, stat: str) -> list[tuple[int, np.ndarray]]:
        """Opens of a block and their closes, counted from ``stop``; from the far end of the window inwards."""
        out = []
        for opened in range(block, self.width, _BLOCKS):
            closes = np.arange(opened, -1, -1)
            days = opened - closes + 1
            kept = np.ones(len(closes), bool) if self.exclude is None else ~((days <= self.exclude[0]) & (closes + self.stop >= self.exclude[1]))
            # A single day has no slope.
            kept &= days > (1 if stat == SLOPE else 0)
            if kept.any():
                out.append((opened, closes[kept]))
        return out


def _runs(columns: list[pa.Array]) -> list[tuple[int, int, tuple]]:
    """Stretches of rows that agree in all columns."""
    rows = list(zip(*[c.to_pylist() for c in columns], strict=True))
    cuts = [i for i in range(len(rows)) if i == 0 or rows[i] != rows[i - 1]]
    return [(a, b, rows[a]) for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True)]


class _Unit:
    """The sums of the events of one chunk and copy, as they pass."""

    def __init__(self, windows: _Windows, stats: list[str], quad: bool, blocks: range, repeats: int):
        self.windows, self.quad, self.repeats = windows, quad, repeats
        self.todo = [(stat, block, of) for stat in stats for block in blocks if (of := windows.of(block, stat))]
        self.sums = [np.zeros((sum(len(c) for _, c in of), len(MOMENTS) + repeats * (1 + quad))) for _, _, of in self.todo]
        days = windows.width + 1
        # Products of running sums with the responses: of values, of values times days, and of values times the event's base.
        self.running = [np.zeros((days, repeats)) for _ in range(3)]

    def add(self, sums: np.ndarray, tsums: np.ndarray, base: np.ndarray, y: np.ndarray, ys: np.ndarray) -> None:
        for total, values in zip(self.running, (sums, tsums, sums * base), strict=True):
            total += values @ ys
        n, sy, syy = float(len(y)), y.sum(), y @ y
        for (stat, _, of), out in zip(self.todo, self.sums, strict=True):
            at = 0
            for opened, closes in of:
                lo, hi = self.windows.width - 1 - opened, self.windows.width - closes
                d = (opened - closes + 1.0)[:, None]
                rows = slice(hi[0], hi[-1] + 1) if hi[-1] - hi[0] + 1 == len(hi) else hi
                x = sums[rows] - sums[lo]
                if stat == MEAN:
                    x /= d
                else:
                    x = (tsums[rows] - tsums[lo] - ((2 * lo + d - 1) / 2 + base) * x) / (d * (d * d - 1) / 12)
                squared = x * x
                part = out[at:at + len(closes)]
                part[:, :len(MOMENTS)] += np.stack([
                    np.full(len(x), n), x.sum(1), squared.sum(1), np.einsum("ij,ij->i", squared, x),
                    np.einsum("ij,ij->i", squared, squared), np.full(len(x), sy), np.full(len(x), syy),
                ], axis=1)
                if self.quad:
                    part[:, len(MOMENTS) + self.repeats:] += squared @ ys
                at += len(closes)

    def done(self) -> list[tuple[str, int, np.ndarray]]:
        values, timed, based = self.running
        for (stat, _, of), out in zip(self.todo, self.sums, strict=True):
            at = 0
            for opened, closes in of:
                lo, hi = self.windows.width - 1 - opened, self.windows.width - closes
                d = (opened - closes + 1.0)[:, None]
                product = values[hi] - values[lo]
                if stat == MEAN:
                    product = product / d
                else:
                    product = (timed[hi] - timed[lo] - (2 * lo + d - 1) / 2 * product - (based[hi] - based[lo])) / (d * (d * d - 1) / 12)
                out[at:at + len(closes), len(MOMENTS):len(MOMENTS) + self.repeats] = product
                at += len(closes)
        return [(stat, block, out) for (stat, block, _), out in zip(self.todo, self.sums, strict=True)]


def _rows(keys: tuple, stats: list[str], blocks: list[int], repeats: int, sums: list[np.ndarray], kinds: pa.Schema) -> pa.RecordBatch:
    n = len(stats)
    columns = [pa.array([k] * n, f.type) for k, f in zip(keys, kinds, strict=False)]
    offsets = np.cumsum([0, *(v.size for v in sums)]).astype(np.int32)
    flat = pa.array(np.concatenate([v.ravel() for v in sums]))
    columns += [pa.array(stats), pa.array(blocks, pa.int32()), pa.array([repeats] * n, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), flat)]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], names=kinds.names)


def _products(n_keys: int, windows: _Windows, stats: list[str], quad: bool, copies: int, kinds: pa.Schema):
    """Task side: rows sorted by unit, the keys, chunk and copy first, to one array of sums per block of windows."""
    def flushed(unit: tuple, held: _Unit) -> Iterator[pa.RecordBatch]:
        for stat, block, sums in held.done():
            yield _rows(unit[:n_keys], [stat], [block], held.repeats, [sums], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, _EVENTS_AT_A_TIME):
                batch = whole.slice(at, _EVENTS_AT_A_TIME)
                for a, b, now in _runs(batch.columns[:n_keys + 2]):
                    part = batch.slice(a, b - a)
                    repeats = len(part.column("ys")[0])
                    if now != unit:
                        if held is not None:
                            yield from flushed(unit, held)
                        unit, held = now, _Unit(windows, stats, quad, range(now[-1], _BLOCKS, copies), repeats)
                    sums, tsums = (np.ascontiguousarray(matrix_of(part.column(c), windows.width + 1).T) for c in ("sums", "tsums"))
                    base, y = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("base", "y"))
                    held.add(sums, tsums, base, y, matrix_of(part.column("ys"), repeats))
        if held is not None:
            yield from flushed(unit, held)

    return run


def _merged(n_keys: int, kinds: pa.Schema):
    """Task side: rows sorted by all but their sums, added up one by one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        for batch in batches:
            for a, b, now in _runs(batch.columns[:n_keys]):
                if now != held:
                    if held is not None:
                        yield _rows(held[:-3], [held[-3]], [held[-2]], held[-1], [total], kinds)
                    held, total = now, 0.0
                for i in range(a, b):
                    total = total + batch.column("sums")[i].values.to_numpy(zero_copy_only=False)
        if held is not None:
            yield _rows(held[:-3], [held[-3]], [held[-2]], held[-1], [total], kinds)

    return run


def _unfolded(n_keys: int, windows: _Windows, quad: bool, schema: pa.Schema):
    """Task side: an array of sums per block to a row per window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                *keys, stat, block, repeats = (batch.column(c)[i].as_py() for c in range(n_keys + 3))
                of, m = windows.of(block, stat), len(MOMENTS)
                numbers = np.concatenate([opened * windows.width + closes for opened, closes in of]).astype(np.int32)
                sums = batch.column("sums")[i].values.to_numpy(zero_copy_only=False).reshape(len(numbers), -1)
                lists = [lists_of(sums[:, m:m + repeats]), lists_of(sums[:, m + repeats:])]
                columns = [pa.array([k] * len(numbers), f.type) for k, f in zip(keys, schema, strict=False)]
                columns += [pa.array([stat] * len(numbers)), pa.array(numbers), *[pa.array(np.ascontiguousarray(sums[:, j])) for j in range(m)], *lists]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], names=schema.names)

    return run
