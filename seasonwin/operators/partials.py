"""Sums of arrays over all tasks, added up in a tree so that one row reaches the driver."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# Send the functions that run in tasks with their code, so that executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUMS = "sums array<double>"


def packed(matrix: np.ndarray) -> np.ndarray:
    """The upper triangle of one symmetric matrix, or of many in the last two dimensions."""
    rows, columns = np.triu_indices(matrix.shape[-1])
    return matrix[..., rows, columns]


def unpacked(triangle: np.ndarray, size: int) -> np.ndarray:
    rows, columns = np.triu_indices(size)
    out = np.zeros((*triangle.shape[:-1], size, size))
    out[..., rows, columns] = triangle
    out[..., columns, rows] = triangle
    return out


def triangle_size(size: int) -> int:
    return size * (size + 1) // 2


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def lists_of(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(matrix, float).ravel()))


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            column = batch.column(0)
            added = matrix_of(column, len(column[0])).sum(axis=0)
            total = added if total is None else total + added
    if total is not None:
        yield pa.RecordBatch.from_arrays([lists_of(total[None, :])], ["sums"])


def added_up(rows: DataFrame) -> np.ndarray | None:
    """The element-wise sum of the one column of arrays, all of a length; nothing of no rows.

    Tasks add what they hold, a square root of their number adds these sums, one task
    the rest: no task or driver holds more than one array at a time.
    """
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    some = rows.mapInArrow(_add, SUMS).repartition(math.isqrt(tasks)).mapInArrow(_add, SUMS)
    row = some.repartition(1).mapInArrow(_add, SUMS).first()
    return None if row is None else np.asarray(row[0])
