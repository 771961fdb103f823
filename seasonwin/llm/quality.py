"""Quality of documents from their statistics (operator 3).

Statistics of a text (lengths, shares of kinds of signs, repetition) are mapped
by random Fourier features, whose inner products approximate a Gaussian kernel.
Ridge regression on labels solves normal equations that every partition sums up
for its rows; isotonic regression turns its output into a probability.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwin.llm.common import held_out, pieces_of, texts_of
from seasonwin.llm.near_dedup import words_of
from seasonwin.session import pin

# Functions that run in tasks travel with their code, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SIGNS = {
    "space": b" \t\x0b\x0c\r\n", "line": b"\n", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789",
    "stop": b".?!", "mark": b",;:'\"()-", "cry": b"!", "symbol": b"#$%&*+/<=>@[\\]^_`{|}~", "bar": b"|", "beyond": bytes(range(128, 256)),
}
_TABLE = np.stack([np.isin(np.arange(256), np.frombuffer(s, np.uint8)) for s in _SIGNS.values()]).astype(np.uint8)
FEATURES = 24
WAVES = 256


def _sums(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[high] - total[low]).astype(float)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text."""
    size = np.asarray(pc.binary_length(texts), np.int64)
    data = np.frombuffer((" ".join(texts.to_pylist()) + " ").encode(), np.uint8)
    high = np.cumsum(size + 1)
    low = high - size - 1
    sign = {name: _sums(row[data], low, high - 1) for name, row in zip(_SIGNS, _TABLE, strict=True)}
    space = _TABLE[0][data].astype(bool)
    before = np.concatenate([[True], space[:-1]])
    first, last = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    a, b = np.searchsorted(first, low), np.searchsorted(first, high)
    length = last - first
    words, chars = np.maximum(b - a, 1), np.maximum(size - sign["space"], 1)
    is_upper, is_lower = _TABLE[2][data], _TABLE[3][data]
    uppers = np.concatenate([[0], np.cumsum(is_upper, dtype=np.int64)])
    lowers = np.concatenate([[0], np.cumsum(is_lower, dtype=np.int64)])
    shouted = (uppers[last] - uppers[first] > 1) & (lowers[last] == lowers[first])
    named = (is_upper[first] == 1) & (lowers[last] > lowers[first]) if len(first) else shouted
    marked = _TABLE[8][data[last - 1]] == 1 if len(first) else shouted
    hashes, counts = words_of(texts)
    distinct, most, twice = np.ones(len(size)), np.zeros(len(size)), np.zeros(len(size))
    for i, (x, y) in enumerate(zip(np.cumsum(counts) - counts, np.cumsum(counts), strict=True)):
        if y > x:
            own, times = np.unique(hashes[x:y], return_counts=True)
            distinct[i], most[i] = len(own) / (y - x), times.max() / (y - x)
            if y - x > 2:
                pair = hashes[x : y - 1] * np.uint64(3) + hashes[x + 1 : y]
                twice[i] = 1 - len(np.unique(pair)) / len(pair)
    letters = np.maximum(sign["upper"] + sign["lower"] + sign["beyond"], 1)
    mean = _sums(length, a, b) / words
    spread = np.sqrt(np.maximum(_sums(length * length, a, b) / words - mean * mean, 0))
    out = np.stack([
        np.log1p(size), np.log1p(b - a), mean, spread, sign["upper"] / letters, sign["digit"] / chars, sign["mark"] / chars,
        sign["symbol"] / chars, np.sqrt(sign["symbol"] / chars), sign["cry"] / words, sign["bar"] / words, sign["beyond"] / chars,
        sign["line"] / words, np.log1p(sign["line"]), sign["stop"] / words, _sums(marked, a, b) / words, _sums(shouted, a, b) / words,
        _sums(named, a, b) / words, _sums(length <= 3, a, b) / words, _sums(length > 12, a, b) / words, distinct,
        distinct * np.log1p(words), most, twice,
    ], axis=1)
    return np.where((b > a)[:, None], out, 0.0)


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``x``, the statistics; null texts are empty and give zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, slab in pieces_of(batch, text, 1 << 21):
                x = statistics(texts_of(slab, text)).astype(np.float32)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), FEATURES).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([slab.column(doc_id), flat], ["doc_id", "x"])

    rows = docs.select(F.col(doc_id).cast("long").alias(doc_id), text)
    return rows.mapInArrow(run, "doc_id long, x array<float>")


@dataclass
class Model:
    """What scoring needs: scales, waves, weights, and the calibration's corner points."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    corners: np.ndarray
    levels: np.ndarray

    def mapped(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / WAVES) * np.cos(z @ self.waves + self.shift), np.ones((len(x), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.mapped(x) @ self.weights
        level = np.interp(raw, self.corners, self.levels)
        # Within a flat step of the calibration, the order of the ridge scores is kept.
        return np.clip(0.998 * level + 0.002 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing steps that fit ``y`` best, by pooling neighbours: centres and levels."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, r])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, n2, r2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2] + r2]
    # A little of the overall rate in each block keeps small ones off 0 and 1.
    rate = float(np.mean(y))
    return np.array([r / n for _, n, r in blocks]), np.array([(v + rate) / (n + 1) for v, n, _ in blocks])


def training_rows(labels: DataFrame, label: str, most: int, doc_id: str = "doc_id") -> DataFrame:
    """At most ``most`` labelled documents (the first by a hash) that may be learned from: ``doc_id, y``."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    rows = known.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(most)


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality", most: int = 40_000, ridge: float = 1e-3, seed: int = 3) -> Model | None:
    """Learn from a bounded sample of labelled rows; None if there are none.

    The driver gets one square matrix per partition of that sample (8), and the
    sample's scores and labels for the calibration.
    """
    sample = pin(training_rows(labels, label, most).join(measured, "doc_id").repartition(8, "doc_id"), "sample")
    wide = [F.col("x")[i].cast("double") for i in range(FEATURES)]
    stats = sample.agg(F.count(F.lit(1)), *(F.avg(c) for c in wide), *(F.stddev_pop(c) for c in wide)).first()
    if not stats[0]:
        return None
    drawn = np.random.default_rng(seed)
    mean, scale = np.array(stats[1 : FEATURES + 1], float), np.array(stats[FEATURES + 1 :], float)
    model = Model(
        mean, np.where(scale > 1e-9, scale, 1.0), drawn.normal(size=(FEATURES, WAVES)) / 4, drawn.uniform(0, 2 * np.pi, WAVES),
        np.zeros(WAVES + 1), np.zeros(1), np.zeros(1),
    )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((WAVES + 1, WAVES + 1)), np.zeros(WAVES + 1)
        for batch in batches:
            z = model.mapped(_matrix(batch.column("x")))
            left += z.T @ z
            right += z.T @ np.asarray(batch.column("y"))
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()]), pa.array([right.tobytes()])], ["left", "right"])

    left, right = np.zeros((WAVES + 1, WAVES + 1)), np.zeros(WAVES + 1)
    for row in sample.mapInArrow(sums, "left binary, right binary").collect():
        left += np.frombuffer(row.left).reshape(left.shape)
        right += np.frombuffer(row.right)
    penalty = np.full(WAVES + 1, ridge * stats[0])
    penalty[-1] = 1e-9
    model.weights = np.linalg.solve(left + np.diag(penalty), right)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = model.mapped(_matrix(batch.column("x"))) @ model.weights
            yield pa.RecordBatch.from_arrays([pa.array(z), batch.column("y")], ["raw", "y"])

    scored = sample.mapInArrow(raw, "raw double, y double").toPandas().sort_values(["raw", "y"])
    model.corners, model.levels = isotonic(scored["raw"].to_numpy(), scored["y"].to_numpy())
    return model


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Null and empty texts are scored like others, by statistics that are all
    zero. Rows that repeat an id are each scored; without labels every score
    is 0.5. Only ``doc_id`` and ``text`` are read, the first never as an input of a score.
    """
    measured = pin(features(docs, doc_id, text), "statistics")
    model = fit(measured, labels, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    scored = measured.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, that the classifier doesn't reject; one with a null id stays.

    Rows that repeat an id go only if all of them are rejected.
    """
    scored = pin(score(docs, labels, threshold=threshold, doc_id=doc_id, text=text), "scores")
    bad = scored.groupBy("doc_id").agg(F.max("predicted").alias("_p")).where("_p = 0 and doc_id is not null")
    bad = bad.select(F.col("doc_id").alias("_bad"))
    return docs.join(pin(bad, "rejected"), F.col(f"`{doc_id}`").cast("long") == F.col("_bad"), "left_anti")
