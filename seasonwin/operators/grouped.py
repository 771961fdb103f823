"""Additive models in which one grouping has a block of coefficients per level, however many levels there are.

A row's part of the design is its shared columns and, for the grouping, its
level and the values of that level's block: nothing is as wide as the number of
levels. The normal matrix is block-diagonal but for a border of shared
coefficients. Rows lie together by level, so a pass leaves one array of sums per
level; tasks invert the blocks, add up what is left of the border (its Schur
complement), and with the solved border complete each level by itself. Only the border
and a few sums reach the driver.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seasonwin.functions import basis as B
from seasonwin.operators import models as M
from seasonwin.operators.joins import attach
from seasonwin.operators.partials import SUMS, added_up, lists_of, matrix_of, packed, triangle_size, unpacked
from seasonwin.session import pin

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Levels or rows that are multiplied at a time.
_ROWS = 2048


@dataclass(frozen=True)
class GroupedModel:
    """A fitted model: shared coefficients ``beta`` as in an ``AdditiveModel``, and a block per level.

    ``blocks`` has ``level, coef, cov, cross, lam``: the block's coefficients, their
    covariance, that with ``beta`` (block by border, row by row), and its smoothing parameters.
    """

    shared: M.AdditiveModel
    group: str
    block_terms: tuple
    blocks: DataFrame
    levels: int

    @property
    def size(self) -> int:
        return sum(_size(t) for t in self.block_terms)

    def block_row(self) -> Column:
        return _block_row(self.block_terms)

    @property
    def y(self):
        return self.shared.y

    @property
    def columns(self) -> list[str]:
        return sorted({c for t in (*self.shared.terms, *self.block_terms) for c in t.columns})


def _size(term) -> int:
    return 1 if isinstance(term, M.RandomIntercept) else term.smooth.k


def _block_row(terms: Sequence) -> Column:
    """The values of one level's block."""
    return F.concat(*[F.array(F.lit(1.0)) if isinstance(t, M.RandomIntercept) else t.smooth.array() for t in terms])


def _penalty(term) -> np.ndarray:
    if isinstance(term, M.RandomIntercept):
        return np.eye(1)
    (curve,) = term.smooth.penalties()
    # The ridge part shrinks what the differences leave free, so that every block can be inverted.
    return curve + M.SHRINK * np.eye(term.smooth.k)


def _slots(terms: Sequence) -> list[slice]:
    ends = np.cumsum([0, *(_size(t) for t in terms)])
    return [slice(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:])]


# ------------------------------------------------------------------ sums per level


def _stretches(level: pa.Array) -> np.ndarray:
    """Where runs of equal levels begin."""
    n = len(level)
    if n < 2:
        return np.zeros(min(n, 1), dtype=np.int64)
    other = pc.fill_null(pc.not_equal(level.slice(1), level.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(other) + 1])


def _level_sums(p: int, k: int, family: str, level_type: pa.DataType):
    """Task side: rows ``level, x, z, y`` and perhaps ``eta``, levels together, to sums per level and of the border.

    A level's are Z'WX, the triangle of Z'WZ and Z'Wz. The border's, one row per task
    without a level, are the triangle of X'WX, X'Wz, then z'Wz, n, deviance, log-likelihood, the sum of y and Pearson's statistic.
    """
    width = k * p + triangle_size(k) + k

    def rows(levels: list, sums: np.ndarray, border: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(levels, level_type), pa.array([border] * len(levels)), lists_of(sums)], ["level", "border", "sums"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xwx, xwz, rest = np.zeros((p, p)), np.zeros(p), np.zeros(6)
        held, running = None, np.zeros(width)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                x, z = matrix_of(batch.column(1), p), matrix_of(batch.column(2), k)
                y = batch.column(3).to_numpy(zero_copy_only=False).astype(float)
                eta = batch.column(4).to_numpy(zero_copy_only=False) if batch.num_columns > 4 else None
                w, target, more = M.working(y, eta, family)
                xw, zw = x * w[:, None], z * w[:, None]
                xwx += xw.T @ x
                xwz += xw.T @ target
                rest += more
                each = np.concatenate([
                    (zw[:, :, None] * x[:, None, :]).reshape(len(y), k * p), packed(zw[:, :, None] * z[:, None, :]), zw * target[:, None],
                ], axis=1)
                starts = _stretches(batch.column(0))
                sums, names = np.add.reduceat(each, starts, axis=0), batch.column(0).take(pa.array(starts)).to_pylist()
                if held is not None and names[0] == held:
                    sums[0] += running
                elif held is not None:
                    yield rows([held], running[None, :], False)
                held, running = names[-1], sums[-1]
                if len(names) > 1:
                    yield rows(names[:-1], sums[:-1], False)
        if held is not None:
            yield rows([held], running[None, :], False)
            yield rows([None], np.concatenate([packed(xwx), xwz, rest])[None, :], True)

    return run


def _merged(level_type: pa.DataType):
    """Task side: rows ``level, sums`` sorted by level, to one row per level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, running = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _stretches(batch.column(0))
            values = matrix_of(batch.column(1), len(batch.column(1)[0]))
            sums, names = np.add.reduceat(values, starts, axis=0), batch.column(0).take(pa.array(starts)).to_pylist()
            if held is not None and names[0] == held:
                sums[0] += running
            elif held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([held], level_type), lists_of(running[None, :])], ["level", "sums"])
            held, running = names[-1], sums[-1]
            if len(names) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(names[:-1], level_type), lists_of(sums[:-1])], ["level", "sums"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], level_type), lists_of(running[None, :])], ["level", "sums"])

    return run


def _sums(rows: DataFrame, p: int, k: int, family: str) -> tuple[DataFrame, M.Sums | None]:
    kind = rows.schema["level"].dataType
    arrow = to_arrow_schema(T.StructType([T.StructField("level", kind)])).field(0).type
    level = f"level {kind.simpleString()}"
    partial = pin(rows.mapInArrow(_level_sums(p, k, family, arrow), f"{level}, border boolean, {SUMS}"), "level_sums")
    border = added_up(partial.where("border").select("sums"))
    # A level that many tasks hold a part of has a row of each; they pass one by one.
    per_level = partial.where("not border").select("level", "sums").repartition("level").sortWithinPartitions("level")
    merged = pin(per_level.mapInArrow(_merged(arrow), f"{level}, {SUMS}"), "levels")
    return merged, None if border is None else M.Sums.unpack(border, p)


# ------------------------------------------------------------------ solving


@dataclass(frozen=True)
class _Blocks:
    """What tasks need to know of the blocks: sizes and penalties. ``lam`` below has a column per term."""

    p: int
    k: int
    slots: tuple
    penalties: tuple

    def split(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kp, tri = self.k * self.p, triangle_size(self.k)
        return sums[:, :kp].reshape(-1, self.k, self.p), unpacked(sums[:, kp:kp + tri], self.k), sums[:, kp + tri:]

    def inverse(self, zwz: np.ndarray, lam: np.ndarray) -> np.ndarray:
        a = zwz.copy()
        for t, (at, pen) in enumerate(zip(self.slots, self.penalties)):
            a[:, at, at] += lam[:, t, None, None] * pen
        return np.linalg.inv(a)


def _updated(lam: np.ndarray, gain: np.ndarray, cost: np.ndarray, traces: Sequence[float], phi: float) -> np.ndarray:
    """One step of the generalised Fellner-Schall rule, as in ``models``."""
    step = phi * np.maximum(gain, 1e-12) / np.maximum(cost, 1e-12 * np.asarray(traces) * phi)
    return np.clip(lam * step, *M.LAMBDA_RANGE)


def _lambdas(batch: pa.RecordBatch, shared: np.ndarray) -> np.ndarray:
    """A level's smoothing parameters: the shared ones, and its own where these are missing."""
    out = np.tile(shared, (batch.num_rows, 1))
    own = np.isnan(shared)
    if own.any():
        out[:, own] = matrix_of(batch.column("lam"), len(shared))[:, own]
    return out


def _schur(b: _Blocks, shared: np.ndarray):
    """Task side: what the levels take from the border's matrix and right-hand side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, right = np.zeros((b.p, b.p)), np.zeros(b.p)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                zwx, zwz, zwy = b.split(matrix_of(batch.column("sums"), b.k * b.p + triangle_size(b.k) + b.k))
                g = b.inverse(zwz, _lambdas(batch, shared)) @ zwx
                matrix += np.einsum("mkp,mkq->pq", zwx, g)
                right += np.einsum("mkp,mk->p", g, zwy)
        yield pa.RecordBatch.from_arrays([lists_of(np.concatenate([packed(matrix), right])[None, :])], ["sums"])

    return run


def _completed(b: _Blocks, shared: np.ndarray, beta: np.ndarray, cov: np.ndarray):
    """Task side: the levels' coefficients and covariances, and what the smoothing parameters depend on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                lam = _lambdas(batch, shared)
                zwx, zwz, zwy = b.split(matrix_of(batch.column("sums"), b.k * b.p + triangle_size(b.k) + b.k))
                inverse = b.inverse(zwz, lam)
                coef = np.einsum("mkl,ml->mk", inverse, zwy - zwx @ beta)
                g = inverse @ zwx
                cross = -g @ cov
                spread = inverse - cross @ g.transpose(0, 2, 1)
                gain, cost, edf = np.zeros_like(lam), np.zeros_like(lam), np.full(len(lam), float(b.k))
                for t, (at_t, pen) in enumerate(zip(b.slots, b.penalties)):
                    used = np.einsum("mij,ij->m", spread[:, at_t, at_t], pen)
                    gain[:, t] = len(pen) / np.maximum(lam[:, t], 1e-300) - used
                    cost[:, t] = np.einsum("mi,ij,mj->m", coef[:, at_t], pen, coef[:, at_t])
                    edf -= lam[:, t] * used
                yield pa.RecordBatch.from_arrays([
                    batch.column("level"), batch.column("sums"), lists_of(lam), lists_of(coef), lists_of(spread.reshape(len(lam), -1)),
                    lists_of(cross.reshape(len(lam), -1)), lists_of(gain), lists_of(cost), pa.array(edf),
                    pa.array(np.einsum("mk,mk->m", coef, zwy)), pa.array((lam * cost).sum(axis=1)),
                ], ["level", "sums", "lam", "coef", "cov", "cross", "gain", "cost", "edf", "explained", "penalty"])

    return run


@dataclass
class _Fit:
    beta: np.ndarray
    cov: np.ndarray
    shared: np.ndarray
    border_lambdas: list[float]
    blocks: DataFrame
    edf: float
    rss: float
    settled: bool


def _solve(levels: DataFrame, s: M.Sums, b: _Blocks, border: M.Border, shared: np.ndarray, chosen: list[float], own: np.ndarray, choose: bool, family: str) -> _Fit:
    """Solve for given smoothing parameters, or choose these too: a border and a block step each round.

    ``levels`` has ``level, sums, lam``. Terms marked in ``own`` have a parameter per level, kept in its row.
    """
    arrays = "lam array<double>, coef array<double>, cov array<double>, `cross` array<double>, gain array<double>, cost array<double>"
    schema = f"level {levels.schema['level'].dataType.simpleString()}, {SUMS}, {arrays}, edf double, explained double, penalty double"
    traces = [float(np.trace(p)) for p in b.penalties]
    settled = not choose
    for _ in range(M.MAX_UPDATES if choose else 1):
        taken = added_up(levels.select("level", "sums", "lam").mapInArrow(_schur(b, shared), SUMS))
        a = s.xwx + border.penalty(chosen) + border.ridge(s.xwx)
        right = s.xwz
        if taken is not None:
            tri = triangle_size(b.p)
            a, right = a - unpacked(taken[:tri], b.p), right - taken[tri:]
        cov = np.linalg.inv(a)
        beta = cov @ right
        done = levels.select("level", "sums", "lam").mapInArrow(_completed(b, shared, beta, cov), schema)
        # Parameters of single levels travel with their rows; without these only sums are needed until the end.
        if not choose or own.any():
            done = pin(done, "blocks")
        sums = done.agg(
            F.sum("edf"), F.sum("explained"), F.sum("penalty"),
            *[F.sum(F.get(c, F.lit(t))) for c in ("gain", "cost") for t in range(len(traces))],
        ).first()
        sums = np.array([v or 0.0 for v in sums])
        gains, costs = sums[3:3 + len(traces)], sums[3 + len(traces):]
        edf = border.free(cov, chosen, s.xwx).sum() + sums[0]
        rss = max(s.zwz - beta @ s.xwz - sums[1] - beta @ border.penalty(chosen) @ beta - sums[2], 1e-300)
        if settled:
            break
        phi = 1.0 if family == M.POISSON else rss / max(s.n - edf, 1.0)
        newer = border.step(chosen, beta, cov, phi)
        next_shared = np.where(own, np.nan, _updated(np.where(own, 1.0, shared), gains, costs, traces, phi))
        moves = [abs(math.log(n / o)) for n, o in zip([*newer, *next_shared[~own]], [*chosen, *shared[~own]])]
        if own.any():
            step = F.transform(F.arrays_zip("lam", "gain", "cost"), lambda v, i: F.least(F.lit(M.LAMBDA_RANGE[1]), F.greatest(
                F.lit(M.LAMBDA_RANGE[0]), v["lam"] * phi * F.greatest(v["gain"], F.lit(1e-12))
                / F.greatest(v["cost"], F.get(F.array(*map(F.lit, traces)), i) * F.lit(1e-12 * phi))
            )))
            moved = done.withColumn("_new", step)
            far = F.array_max(F.transform(F.arrays_zip("lam", "_new"), lambda v, i: F.when(
                F.get(F.array(*map(F.lit, own.tolist())), i), F.abs(F.log(v["_new"] / v["lam"]))).otherwise(0.0)))
            moves.append(moved.agg(F.max(far)).first()[0] or 0.0)
            levels = moved.select("level", "sums", F.col("_new").alias("lam"))
        chosen, shared = newer, next_shared
        settled = max(moves, default=0.0) < 0.01
        if settled:
            break
    if choose:
        final = _solve(levels, s, b, border, shared, chosen, own, False, family)
        final.settled = settled
        return final
    return _Fit(beta, cov, shared, chosen, done, edf, rss, settled)


def fit_grouped(
    df: DataFrame, y: str, terms: Sequence[M.Term], group: str, family: str = M.GAUSSIAN, lambdas: Sequence[float] | None = None,
    max_iter: int = 25, tol: float = 1e-8,
) -> GroupedModel:
    """Fit ``y`` by an intercept and terms, those in ``group`` (``RandomIntercept``, ``BySmooth``) with a block per level.

    Any number of levels. Rows with a missing input are left out. ``lambdas``
    fixes the smoothing parameters, first those of the shared terms' penalties, then one for each
    term in ``group``; they multiply the penalties as these are. Otherwise they are chosen
    by restricted maximum likelihood: one for all levels of a random intercept or of curves that are ``shared``, one
    for each level of other curves. Block terms are not centred; their penalties tell them from the shared ones.
    ``converged`` of the shared model says whether the choice and the iterations ended by themselves.
    """
    blocks = tuple(t for t in terms if getattr(t, "group", None) == group)
    others = [t for t in terms if t not in blocks]
    if not blocks:
        raise ValueError(f"no term in {group}")
    inputs = sorted({c for t in terms for c in t.columns})
    rows = pin(df.select(y, *[c for c in inputs if c != y]).dropna(), "rows")
    border = M.prepare_border(rows, others)
    stats, _ = M.describe(rows, [t.smooth for t in blocks if isinstance(t, M.BySmooth)])
    blocks = tuple(M.replace(t, smooth=t.smooth.prepare(stats, {})) if isinstance(t, M.BySmooth) else t for t in blocks)
    b = _Blocks(border.p, sum(_size(t) for t in blocks), tuple(_slots(blocks)), tuple(_penalty(t) for t in blocks))
    design = rows.select(
        F.col(group).alias("level"), border.row().alias("x"), _block_row(blocks).alias("z"), F.col(y).cast("double").alias("y"),
        F.monotonically_increasing_id().alias("_read"),
    )
    # Rows of a level lie together; those of a large one are dealt to several ranges.
    design = pin(design.repartitionByRange("level", "_read").sortWithinPartitions("level").drop("_read"), "design")

    levels, s = _sums(design, b.p, b.k, family)
    if s is None:
        raise ValueError("no row has all inputs")
    own = np.array([isinstance(t, M.BySmooth) and not t.shared for t in blocks])
    n_border = len(border.penalties)
    if lambdas is None:
        chosen = [size for size in border.scales(s.xwx)]
        start = np.array([max(s.n, 1.0) / max(levels.count(), 1) / np.trace(p) for p in b.penalties])
    else:
        chosen, start = list(lambdas[:n_border]), np.array(lambdas[n_border:], float)
    choose = lambdas is None
    shared = np.where(own & choose, np.nan, start)
    starting = F.array(*[F.lit(float(v)) for v in start])
    fit = _solve(levels.withColumn("lam", starting), s, b, border, shared, chosen, own & choose, choose, family)
    iterations, converged = 1, fit.settled
    if family != M.GAUSSIAN:
        last, converged = np.inf, False
        for iterations in range(2, max_iter + 1):
            known = attach(design, fit.blocks.select("level", "coef"), ["level"])
            eta = B.dot(F.col("x"), fit.beta) + B.products(F.col("z"), F.col("coef"))
            again = known.select("level", "x", "z", "y", eta.alias("eta")).sortWithinPartitions("level")
            levels, s = _sums(again, b.p, b.k, family)
            if abs(last - s.deviance) <= tol * (abs(s.deviance) + 0.1):
                converged = fit.settled
                break
            last = s.deviance
            # After a few steps the weights barely move; keep the choice and let it converge.
            repeat = choose and iterations <= 6
            at = attach(levels, fit.blocks.select("level", "lam"), ["level"])
            settled = fit.settled
            fit = _solve(at, s, b, border, fit.shared, fit.border_lambdas, own & choose, repeat, family)
            fit.settled = fit.settled if repeat else settled
    deviance = fit.rss if family == M.GAUSSIAN else s.deviance
    scale, aic = M.scale_and_aic(family, s, deviance, fit.edf)
    shell = border.model(y, family)
    model = M.replace(
        shell, beta=fit.beta, cov=fit.cov * scale, edf=border.free(fit.cov, fit.border_lambdas, s.xwx),
        lambdas=tuple(fit.border_lambdas), n=int(s.n), scale=scale, deviance=deviance, null_deviance=M.null_deviance(rows, y, family),
        aic=aic, iterations=iterations, converged=converged, total_edf=float(fit.edf),
    )
    scaled = [F.transform(c, lambda v: v * F.lit(float(scale))).alias(c) for c in ("cov", "cross")]
    kept = pin(fit.blocks.select("level", "coef", *scaled, "lam", "edf"), "group_blocks")
    return GroupedModel(model, group, blocks, kept, kept.count())


# ------------------------------------------------------------------ results


def group_coefficients(model: GroupedModel) -> DataFrame:
    """``level, term, i, estimate, se`` of every block."""
    names = [F.struct(F.lit(t.name).alias("term"), F.lit(i).alias("i")) for t in model.block_terms for i in range(_size(t))]
    k = model.size
    each = model.blocks.select("level", "coef", "cov", F.posexplode(F.array(*names)).alias("_at", "_name"))
    variance = F.get("cov", F.col("_at") * (k + 1))
    return each.select(
        F.col("level").alias(model.group), "_name.term", "_name.i", F.get("coef", F.col("_at")).alias("estimate"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("se"),
    )


def score_grouped(df: DataFrame, model: GroupedModel, type: str = "response", se: bool = False) -> DataFrame:
    """Add ``fit`` (and ``se``). Rows with a missing input get none; a level that wasn't fitted has the shared part only."""
    known = F.lit(True)
    for c in model.columns:
        known = known & F.col(c).isNotNull()
    shared, p, k = model.shared, len(model.shared.beta), model.size
    values = ["coef", "cov", "cross"] if se else ["coef"]
    found = model.blocks.select(F.col("level").alias(model.group), *[F.col(v).alias(f"_{v}") for v in values])
    joined = attach(df, found, [model.group]).withColumns({"_x": F.when(known, shared.row()), "_z": F.when(known, model.block_row())})
    eta = B.dot(F.col("_x"), shared.beta) + F.coalesce(B.products(F.col("_z"), F.col("_coef")), F.lit(0.0))
    response = shared.log_link and type == "response"
    fit = F.when(known, F.exp(eta) if response else eta)
    if not se:
        return joined.withColumn("fit", fit).drop("_x", "_z", "_coef")
    spread = shared.cov.tolist()
    schema = T.StructType([*df.schema.fields, T.StructField("fit", T.DoubleType()), T.StructField("se", T.DoubleType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = np.asarray(spread)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                columns = {c: batch.column(c) for c in ("_x", "_z", "_cov", "_cross")}
                there = np.asarray(columns["_x"].is_valid())
                level = there & np.asarray(columns["_cov"].is_valid())
                x = np.zeros((batch.num_rows, p))
                x[there] = matrix_of(columns["_x"].drop_null(), p)
                variance = np.einsum("ij,ij->i", x @ v, x)
                if level.any():
                    mask = pa.array(level)
                    z, cov = matrix_of(columns["_z"].filter(mask), k), matrix_of(columns["_cov"].filter(mask), k * k).reshape(-1, k, k)
                    cross = matrix_of(columns["_cross"].filter(mask), k * p).reshape(-1, k, p)
                    variance[level] += np.einsum("mi,mij,mj->m", z, cov, z) + 2 * np.einsum("mi,mip,mp->m", z, cross, x[level])
                error = np.sqrt(np.maximum(variance, 0.0))
                kept = [batch.column(c) for c in names[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(error, mask=~there)], names)

    scored = joined.withColumn("fit", fit).drop("_coef").mapInArrow(run, schema)
    return scored.withColumn("se", F.col("fit") * F.col("se")) if response else scored
