"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions that run in tasks travel with their code, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: White space that separates words: space and the control characters 9 to 13.
SPACES = "\\x20\\x09-\\x0D"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The most rows of ids that are sent to every executor; more are joined by shuffle.
SMALL_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. Of pure ASCII text, that is what ``lower`` does."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document are kept from training: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def matching(rows: DataFrame, ids: DataFrame, key: str, at_most: int = SMALL_ROWS) -> DataFrame:
    """The rows whose key is among ``ids``, one narrow column that has been written already.

    Few ids go to the rows, so that wide rows stay where they are; beyond
    ``at_most`` both sides are shuffled. The rows returned are the same.
    """
    if ids.count() <= at_most:
        ids = F.broadcast(ids)
    return rows.join(ids, key, "left_semi")


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Join rows with written groups of them, one row per key, that say how many rows they have.

    A group with more than a 500th of all rows is sent to the rows; there can't be
    500 of them. The others are met by a shuffle in which no key is hot.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) > F.lit(total / 500))
    found = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return found.unionByName(rest.join(groups, keys))


def tasks(spark: SparkSession) -> int:
    """Tasks for few small rows that each stand for much work, which adaptive execution would put together."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    return [n if n.lower() not in taken else f"{n}_{uuid.uuid4().hex[:8]}" for n in names]


def pieces_of(batch: pa.RecordBatch, column: str, most: int = 1 << 24) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Consecutive slices of a batch that hold about ``most`` bytes of the text column each."""
    text = batch.column(column)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(text), 0))
    block = np.cumsum(sizes, dtype=np.int64) // most
    cuts = np.flatnonzero(np.diff(block)) + 1
    for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if high > low:
            yield int(low), batch.slice(int(low), int(high - low))


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The text column, null as the empty text."""
    return pa.compute.fill_null(batch.column(column).cast(pa.string()), "")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every stretch, one after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kept_in_worker(name: str, make: Callable):
    """``make()``, once per Python worker under this name: tasks that follow find it again."""
    held = vars(sys.modules.setdefault("_seasonwin_worker", ModuleType("_seasonwin_worker")))
    if name not in held:
        held[name] = make()
    return held[name]
