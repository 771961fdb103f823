"""Nearest neighbours by inner product over learned partitions (operator 10).

A bounded sample is joined to its nearest neighbours, and that graph is cut
into balanced parts with few edges between them. A small network learns to tell
from a vector the parts in which its neighbours are. It gives every row of the
table its part, and every query the several parts it searches; what is found
there is ranked by the exact measure.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasonwin.llm.common import tasks
from seasonwin.session import pin

# Functions that run in tasks travel with their code, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NEIGHBOURS = 16
_BLOCK = 4096


def usable(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, embedding`` (doubles) of rows with an id and a finite vector that isn't zero, of the commonest length."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0))
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    return rows.where(F.size("embedding") == (lengths[0].n if lengths else 0))


def neighbour_graph(x: np.ndarray, k: int = _NEIGHBOURS) -> np.ndarray:
    """For each row the rows of largest inner product, not itself."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for low in range(0, len(x), 1024):
        s = x[low : low + 1024] @ x.T
        s[np.arange(len(s)), low + np.arange(len(s))] = -np.inf
        out[low : low + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.15, seed: int = 10) -> np.ndarray:
    """A part for each row, none much larger than the others, that keeps neighbours together.

    It starts from directions drawn at random; in each round rows move to the part
    that most of their neighbours are in, those with most to gain first, while there is room.
    """
    drawn = np.random.default_rng(seed)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit[drawn.choice(len(x), parts, replace=False)]
    room = int(np.ceil(slack * len(x) / parts))
    own = np.zeros(len(x), np.int64)
    both = np.concatenate([np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])], axis=1)
    for turn in range(rounds):
        if turn < 4:
            gain = unit @ centres.T
        else:
            gain = np.zeros((len(x), parts))
            np.add.at(gain, (both[0], own[both[1]]), 1.0)
            gain += 0.5 * (np.arange(parts) == own[:, None]) + 0.1 * (unit @ centres.T)
        wishes = np.argsort(-gain, axis=1)
        ordered = np.take_along_axis(gain, wishes, axis=1)
        first = np.argsort(ordered[:, min(1, parts - 1)] - ordered[:, 0], kind="stable")
        filled = np.zeros(parts, np.int64)
        for i in first:
            for p in wishes[i]:
                if filled[p] < room:
                    own[i], filled[p] = p, filled[p] + 1
                    break
        for p in range(parts):
            if filled[p]:
                c = unit[own == p].sum(axis=0)
                centres[p] = c / max(np.linalg.norm(c), 1e-12)
    return own


@dataclass
class Router:
    """A network with one hidden layer: from a vector to log-probabilities of parts."""

    layers: list[np.ndarray]
    parts: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return _forward(self.layers, x / np.linalg.norm(x, axis=1, keepdims=True))[1]


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = layers
    hidden = np.maximum(x @ a + b, 0)
    return hidden, hidden @ c + d


def train_router(x: np.ndarray, goal: np.ndarray, hidden: int = 128, epochs: int = 15, seed: int = 10) -> Router:
    """Fit the network to shares of neighbours per part, by Adam on cross-entropy."""
    drawn = np.random.default_rng(seed)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    n, width, parts = len(x), x.shape[1], goal.shape[1]
    layers = [drawn.normal(size=(width, hidden)) * np.sqrt(2.0), np.zeros(hidden), drawn.normal(size=(hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        for batch in np.array_split(drawn.permutation(n), max(1, n // 256)):
            v = unit[batch]
            h, out = _forward(layers, v)
            p = np.exp(out - out.max(axis=1, keepdims=True))
            e = (p / p.sum(axis=1, keepdims=True) - goal[batch]) / len(batch)
            back = (e @ layers[2].T) * (h > 0)
            step += 1
            for w, g, m, s in zip(layers, (v.T @ back, back.sum(0), h.T @ e, e.sum(0)), first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Router(layers, parts)


def learn(vectors: DataFrame, parts: int = 32, sample: int = 8192, recall: float = 0.95, k: int = 20, seed: int = 10) -> tuple[Router, int] | None:
    """The router of a bounded sample and the number of parts to search; None without vectors.

    The sample, the first ``sample`` rows by a hash, is worked on by the driver.
    An eighth of it is kept from the training of the network: the fewest parts
    in which ``recall`` of the k nearest sample rows of those are found is the number to search.
    """
    rows = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select("embedding").collect()
    if not rows:
        return None
    x = np.array([r.embedding for r in rows], float)
    parts = max(1, min(parts, len(x) // (4 * _NEIGHBOURS)))
    graph = neighbour_graph(x)
    own = balanced_parts(x, graph, parts, seed=seed)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), own[graph].ravel()), 1.0)
    np.add.at(goal, (np.arange(len(x)), own), max(1.0, graph.shape[1] / 2))
    goal /= goal.sum(axis=1, keepdims=True)
    kept = len(x) // 8
    router = train_router(x[kept:], goal[kept:], seed=seed)
    wishes = router(x)
    near = x[:kept] @ x.T
    near[np.arange(kept), np.arange(kept)] = -np.inf
    top = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-wishes[:kept], axis=1, kind="stable"), axis=1)
    rank = np.sort(np.take_along_axis(place, wishes.argmax(axis=1)[top], axis=1).ravel())
    probes = int(rank[min(len(rank) - 1, int(np.ceil(recall * len(rank))))]) + 1 if len(rank) else parts
    return router, probes


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def build_index(vectors: DataFrame, router: Router) -> DataFrame:
    """Every vector with its most probable part: ``vec_id, embedding, part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = router(_matrix(batch.column("embedding"))).argmax(axis=1)
                yield batch.append_column("part", pa.array(part, pa.int32()))

    return vectors.mapInArrow(run, "vec_id long, embedding array<double>, part int")


def _routed(queries: DataFrame, router: Router, counts: np.ndarray, probes: int, least: int) -> DataFrame:
    """Each query once for every part it searches: its most probable ones, and more until they hold ``least`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            wishes = np.argsort(-router(_matrix(batch.column("embedding"))), axis=1, kind="stable")
            held = counts[wishes]
            before = np.cumsum(held, axis=1) - held
            row, rank = np.nonzero((np.arange(wishes.shape[1]) < probes) | (before < least))
            columns = [c.take(pa.array(row)) for c in (batch.column("vec_id"), batch.column("embedding"))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(wishes[row, rank], pa.int32())], ["query_id", "query", "part"])

    return queries.select("vec_id", "embedding").mapInArrow(run, "query_id long, query array<double>, part int")


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of one vector with rows, added up in the same order for every row."""
    return (v * q).sum(axis=1)


def nearest_rows(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of ``v`` for each query, ties to smaller ids, without the query's own id."""
    out_q, out_v, out_s = [], [], []
    for low in range(0, len(q), 512):
        rough = q[low : low + 512] @ v.T
        rough[query_ids[low : low + 512, None] == ids[None, :]] = -np.inf
        top = min(k, rough.shape[1])
        bound = -np.partition(-rough, top - 1, axis=1)[:, top - 1]
        for i, row in enumerate(rough):
            slack = 1e-9 * max(1.0, float(np.abs(row[np.isfinite(row)]).max(initial=0.0)))
            near = np.flatnonzero((row >= bound[i] - slack) & (row > -np.inf))
            s = exact_scores(q[low + i], v[near])
            best = np.lexsort((ids[near], -s))[:k]
            out_q.append(np.full(len(best), query_ids[low + i]))
            out_v.append(ids[near][best])
            out_s.append(s[best])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return join(out_q, np.int64), join(out_v, np.int64), join(out_s, float)


def search(index: DataFrame, queries: DataFrame, router: Router, k: int = 20, probes: int = 8) -> DataFrame:
    """The k nearest found for each query: ``query_id, rank, vec_id, score``.

    Parts are split into blocks and the queries of a part into shares of
    about 4,096 rows, so that a task's matrix is bounded whatever a part holds.
    """
    sizes = index.groupBy("part").count().collect()
    counts = np.zeros(router.parts, np.int64)
    for row in sizes:
        counts[row.part] = row["count"]
    routed = pin(_routed(queries, router, counts, probes, 8 * k), "routed")
    asked = {r.part: r["count"] for r in routed.groupBy("part").count().collect()}
    spark = index.sparkSession
    plan = [(p, int(-(-counts[p] // _BLOCK)), -(-asked[p] // _BLOCK)) for p in range(router.parts) if counts[p] and asked.get(p)]
    plan = F.broadcast(spark.createDataFrame(plan, "part int, blocks int, shares int"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one_of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = index.join(plan, "part").withColumn("block", one_of("vec_id", "blocks")).withColumn("share", all_of("shares"))
    right = routed.join(plan, "part").withColumn("share", one_of("query_id", "shares")).withColumn("block", all_of("blocks"))
    unit = ["part", "block", "share"]

    def rank(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return _FOUND.empty_table()
        own = np.asarray(rows.column("vec_id")), _matrix(rows.column("embedding")), np.asarray(asked.column("query_id")), _matrix(asked.column("query"))
        return pa.table(dict(zip(_FOUND.names, nearest_rows(*own, k), strict=True)), _FOUND)

    n = tasks(spark)
    found = (
        left.select(*unit, "vec_id", "embedding").repartition(n, *unit).groupBy(*unit)
        .cogroup(right.select(*unit, "query_id", "query").repartition(n, *unit).groupBy(*unit))
        .applyInArrow(rank, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def nearest(table: DataFrame, every: int = 20, k: int = 20, parts: int = 32, recall: float = 0.95, sample: int = 8192) -> DataFrame:
    """Search for all rows whose id is divisible by ``every``, against all rows; ``recall`` as in ``learn``.

    Vectors that are null, zero, or hold null or non-finite values take no
    part, nor those of another length than most. Ids should be unique. No
    usable rows give none.
    """
    vectors = pin(usable(table), "vectors")
    learned = learn(vectors, parts, sample, recall, k)
    if learned is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router, probes = learned
    index = pin(build_index(vectors, router), "index")
    return search(index, index.where(F.col("vec_id") % every == 0), router, k, probes)
