"""Packing of documents into sequences by minimum bin slack (operator 1).

A sequence starts with the longest piece left. A bitset then holds every sum
that the other lengths left can make, one shift per length, and the fullest sum
that fits is taken out. Groups of some ten thousand pieces are packed side by
side, each by one task; what stands in sequences that stayed a tenth empty is
packed again, with such pieces of the other groups.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonwin.llm.common import pieces_of, tasks, texts_of
from seasonwin.llm.tokens import crc32_of, encoder
from seasonwin.session import pin

# Functions that run in tasks travel with their code, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PIECES = 20_000
_AGAIN = 1 << 30


def fullest(lengths: np.ndarray, counts: np.ndarray, room: int) -> list[int]:
    """Lengths whose sum is the largest that is at most ``room``; ``lengths`` descend, ``counts`` says how many are left."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length, count in zip(lengths.tolist(), counts.tolist(), strict=True):
        for _ in range(min(count, room // length)):
            wider = (reach | reach << length) & mask
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
        if reach >> room:
            break
    left, taken = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> left & 1:
            taken.append(length)
            left -= length
    return taken


def minimum_bin_slack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each length and its offset there; every length is from 1 to ``capacity``."""
    order = np.argsort(lengths, kind="stable")
    ends = np.searchsorted(lengths[order], np.arange(capacity + 2))
    first, left = ends[:-1], np.diff(ends)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    number, top = 0, capacity
    while top:
        if not left[top]:
            top -= 1
            continue
        left[top] -= 1
        chosen, room = [(top, first[top] + left[top])], capacity - top
        low = np.flatnonzero(left[1 : min(room, top) + 1])[::-1] + 1
        for length in fullest(low, left[low], room) if room else ():
            left[length] -= 1
            chosen.append((length, first[length] + left[length]))
        at = 0
        for length, place in chosen:
            bins[order[place]], offsets[order[place]] = number, at
            at += length
        number += 1
    return bins, offsets


def cut(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Token ids of each document with ``end`` behind them, longer ones than ``capacity`` cut.

    All pieces but a document's first are full. Columns: ``doc_id, piece,
    start, length, ids_crc32`` and, if asked for, ``ids``.
    """
    ids_type = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for _, slab in pieces_of(batch, text):
                flat, bounds = encode.encode(texts_of(slab, text), end)
                sizes = np.diff(bounds)
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = (sizes - (pieces - 1) * capacity)[row]
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                low = bounds[:-1][row] + start
                spans = list(zip(low.tolist(), (low + length).tolist(), strict=True))
                columns = [
                    slab.column(doc_id).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array([crc32_of(flat[a:b]) for a, b in spans], pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([flat[a:b].astype(np.int32) for a, b in spans], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(doc_id).cast("long").alias(doc_id), text)
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ids_type)


def place(pieces: DataFrame, capacity: int = 2048, per_group: int = _PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to written pieces, which have a ``length`` of 1 to ``capacity``."""
    groups = -(-pieces.count() // per_group) or 1
    first = _packed(pieces, groups, capacity, 0)
    if groups == 1:
        return first.drop("_fill")
    first = pin(first, "packed")
    loose = first.where(F.col("_fill") < 0.9 * capacity).drop("sequence_id", "offset", "_fill")
    again = -(-loose.count() // per_group) or 1
    return first.where(F.col("_fill") >= 0.9 * capacity).unionByName(_packed(loose, again, capacity, _AGAIN)).drop("_fill")


def _packed(pieces: DataFrame, groups: int, capacity: int, base: int) -> DataFrame:
    fields = [*pieces.schema.fields, *(T.StructField(n, T.LongType()) for n in ("sequence_id", "offset", "_fill"))]

    def pack(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bins, offsets = minimum_bin_slack(np.asarray(table.column("length")), capacity)
        fill = np.bincount(bins, np.asarray(table.column("length"))).astype(np.int64)
        number = bins + ((base + keys[0].as_py()) << 32)
        table = table.drop_columns("_group")
        for name, values in (("sequence_id", number), ("offset", offsets), ("_fill", fill[bins])):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    # Even groups of narrow rows; the hash of all of a piece's columns tells repeated documents apart where it can.
    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int")
    dealt = pieces.withColumn("_group", group).repartition(min(groups, max(tasks(pieces.sparkSession), groups // 4)), "_group")
    return dealt.groupBy("_group").applyInArrow(pack, T.StructType(fields))


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pack documents into as few sequences of at most ``capacity`` ids as this method finds.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``
    and ``ids`` if asked for. Null and empty texts are the one id ``end``;
    rows that repeat an id are packed like others; no rows give none. Other columns are not read.
    """
    pieces = pin(cut(docs, tokenizer, capacity, end, doc_id, text, with_ids), "pieces")
    return place(pieces, capacity, _PIECES // 5 if with_ids else _PIECES)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, of pieces with ``ids``; a group is one sequence, so it is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
