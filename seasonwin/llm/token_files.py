"""Token ids in binary shards with Elias-Fano coded document boundaries (operator 7).

A shard holds the ids of consecutive documents, one after the other, and two
non-decreasing sequences: where each document begins, and the document ids.
Both are Elias-Fano coded: the low bits of all values side by side, the high
bits as gaps in unary, with the place of every 256th one bit kept, so that any
value is found by looking at one short stretch of bits. n values below u take
about n * (2 + log2(u / n)) bits.

Layout of a shard, little-endian: the 48 bytes of ``_HEAD``, the ids (16 bits
each if the vocabulary allows, else 32), the boundaries, the document ids.
"""

from __future__ import annotations

import posixpath
import struct
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasonwin.llm.common import pieces_of, tasks, texts_of
from seasonwin.llm.tokens import crc32_of, encoder
from seasonwin.session import new_shared_path

# Functions that run in tasks travel with their code, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MAGIC = b"SWTOKEF1"
# magic, bytes an id, documents, documents without id, ids, bytes of ids, bytes of boundaries
_HEAD = "<8sHxxIIxxxxQQQ"
_EVERY = 256
#: Bytes of text that are encoded at once; the arrays made on the way take some ten times as much.
_SLAB = 1 << 23


class EliasFano:
    """A non-decreasing sequence of non-negative integers, read in place from its bytes."""

    _PARTS = "<QQQQQ"

    def __init__(self, data: bytes | memoryview):
        self.base, self.n, self.low_bits, low_bytes, high_bytes = struct.unpack_from(self._PARTS, data)
        at = struct.calcsize(self._PARTS)
        self.low = np.frombuffer(data, np.uint8, low_bytes, at)
        self.high = np.frombuffer(data, np.uint8, high_bytes, at + low_bytes)
        marks = -(-self.n // _EVERY)
        self.marks = np.frombuffer(data, "<u4", marks, at + low_bytes + high_bytes)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, np.int64)
        base = int(values[0]) if len(values) else 0
        x = (values - base).astype(np.uint64)
        n = len(x)
        low_bits = max(0, int((int(x[-1]) + 1) // n).bit_length() - 1) if n else 0
        low = (x[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (x >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        low_data = np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes()
        high_data = np.packbits(high, bitorder="little").tobytes()
        head = struct.pack(cls._PARTS, base & (1 << 64) - 1, n, low_bits, len(low_data), len(high_data))
        return head + low_data + high_data + ones[::_EVERY].astype("<u4").tobytes()

    def _value(self, i, high) -> np.ndarray:
        bits = i[:, None] * self.low_bits + np.arange(self.low_bits)
        low = ((self.low[bits >> 3] >> (bits & 7)) & 1).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        base = self.base - (1 << 64) if self.base >> 63 else self.base
        return base + (high << self.low_bits) + low

    def select(self, i: int) -> int:
        """The i-th value, from the nearest mark on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start, want = int(self.marks[i // _EVERY]), i % _EVERY
        byte, seen = start >> 3, 0
        skip = start & 7
        while True:
            stretch = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
            ones = np.flatnonzero(stretch[skip:]) + skip
            if seen + len(ones) > want:
                at = 8 * byte + int(ones[want - seen])
                return int(self._value(np.array([i]), np.array([at - i]))[0])
            seen, byte, skip = seen + len(ones), byte + 64, 0

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return self._value(i, ones - i)


def pack_shard(ids: np.ndarray, bounds: np.ndarray, doc_ids: list[int | None], width: int) -> bytes:
    """The bytes of a shard; documents without an id come first."""
    missing = sum(d is None for d in doc_ids)
    body = np.ascontiguousarray(ids, f"<u{width}").data
    where = EliasFano.encode(bounds)
    names = EliasFano.encode(np.array(doc_ids[missing:], np.int64))
    head = struct.pack(_HEAD, _MAGIC, width, len(doc_ids), missing, len(ids), body.nbytes, len(where))
    return b"".join([head, body, where, names])


class Shard:
    """A shard's documents: ``ids_of(i)`` needs two selects and one slice."""

    def __init__(self, data: bytes):
        magic, width, self.n, self.missing, n_ids, body, where = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("no token shard")
        view = memoryview(data)
        self.ids = np.frombuffer(data, f"<u{width}", n_ids, struct.calcsize(_HEAD))
        self.bounds = EliasFano(view[struct.calcsize(_HEAD) + body :])
        self.doc_ids = EliasFano(view[struct.calcsize(_HEAD) + body + where :])

    def ids_of(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        bounds = self.bounds.all()
        names = [None] * self.missing + self.doc_ids.all().tolist()
        for i, name in enumerate(names):
            yield name, int(bounds[i]), self.ids[bounds[i] : bounds[i + 1]]


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("s3a:"):
        uri = "s3:" + uri[4:]
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def _put(folder: str, name: str, data: bytes) -> None:
    """Write beside the place and move there: a task that runs twice leaves one whole file."""
    files, path = _file_system(folder)
    files.create_dir(path, recursive=True)
    draft = posixpath.join(path, f".{name}.{uuid.uuid4().hex}")
    with files.open_output_stream(draft) as out:
        out.write(data)
    files.move(draft, posixpath.join(path, name))


def write_shards(
    docs: DataFrame, folder: str, tokenizer: str, end: int = 2, doc_id: str = "doc_id", text: str = "text",
    shard_ids: int = 8_000_000,
) -> DataFrame:
    """Write the ids of all texts to ``folder`` in ascending order of the ids of the documents; returns the manifest.

    One row per shard: ``part, number`` (their order), ``documents``, ``ids``,
    ``start`` (ids in all shards before it), ``file``. ``end`` is appended to
    every document. A shard is closed when it holds ``shard_ids`` ids, so a
    task's memory is bounded by that and the longest text. Null texts are empty,
    a null id sorts first, equal ids stand in any order. The manifest is
    itself written to ``folder``/manifest.
    """
    schema = "part int, number int, documents long, ids long, file string"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer)
        width = 2 if encode.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16 else 4
        ids, sizes, names, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            name = f"shard-{part:08d}-{number:06d}.bin"
            _put(folder, name, pack_shard(np.concatenate(ids), bounds, names, width))
            row = {"part": [part], "number": [number], "documents": [len(names)], "ids": [held], "file": [name]}
            return pa.RecordBatch.from_pydict(row, _SHARD_ROW)

        for batch in batches:
            for _, slab in pieces_of(batch, text, _SLAB):
                flat, bounds = encode.encode(texts_of(slab, text), end)
                ids.append(flat.astype(f"<u{width}"))
                sizes.append(np.diff(bounds))
                names += slab.column(doc_id).to_pylist()
                held += len(flat)
                if held >= shard_ids:
                    yield close()
                    ids, sizes, names, held = [], [], [], 0
                    number += 1
        if names:
            yield close()

    rows = docs.select(F.col(doc_id).cast("long").alias(doc_id), text)
    shards = rows.repartitionByRange(doc_id).sortWithinPartitions(doc_id).mapInArrow(write, schema)
    order = Window.orderBy("part", "number")
    # One row per shard of millions of ids.
    whole = shards.withColumn("start", F.sum("ids").over(order) - F.col("ids"))
    whole.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


_SHARD_ROW = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64()), ("file", pa.string())])


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document, from the files: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32``."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = _file_system(folder)
        for frame in frames:
            for shard in frame.itertuples():
                with files.open_input_stream(posixpath.join(path, shard.file)) as data:
                    found = list(Shard(data.read()).documents())
                yield pd.DataFrame({
                    "doc_id": pd.array([d for d, _, _ in found], "Int64"),
                    "start": [shard.start + s for _, s, _ in found],
                    "n_tokens": [len(i) for _, _, i in found],
                    "ids_crc32": [crc32_of(i) for _, _, i in found],
                })

    # A row stands for a whole file.
    spread = manifest.repartition(tasks(manifest.sparkSession), "file")
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(docs: DataFrame) -> str:
    return new_shared_path(docs.sparkSession, "shards")
