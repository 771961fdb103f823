"""Regression and additive (smooth) models fitted from distributed cross-products.

Each step is one pass over the rows: tasks turn Arrow batches into partial
weighted cross-products, Spark adds those up in a tree, and only their sum, whose size
depends on the number of coefficients, reaches the driver for a small solve.
Smoothing parameters follow from restricted maximum likelihood on the same sums.
Groupings of many levels are fitted by ``grouped``.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonwin.functions import basis as B
from seasonwin.functions.columns import normal_interval
from seasonwin.functions.tails import chi_squared_tail, f_tail
from seasonwin.operators.joins import attach
from seasonwin.operators.partials import SUMS, added_up, lists_of, matrix_of, packed, triangle_size, unpacked

# Send the small functions that run in tasks with their code, so that executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GAUSSIAN, POISSON, QUASIPOISSON = "gaussian", "poisson", "quasipoisson"
# Beyond this the cross-products no longer are a small result.
MAX_COEFFICIENTS = 1000
LAMBDA_RANGE = (1e-8, 1e8)
MAX_UPDATES = 50
# Share of a ridge in the penalty of curves by group: it shrinks what the differences leave free.
SHRINK = 0.01
_RIDGE = 1e-8
# Knots lie at quantiles of a sketch; anywhere near them serves.
_KNOT_ACCURACY = 10_000
_MAX_HALVINGS = 20
_MAX_LOG_MEAN = 30.0


# ------------------------------------------------------------------- terms


@dataclass(frozen=True)
class Linear:
    """A plain linear term."""

    x: str

    @property
    def name(self):
        return self.x

    @property
    def columns(self):
        return [self.x]

    def prepare(self, stats, levels):
        return self

    def array(self) -> Column:
        return F.array(F.col(self.x).cast("double"))

    @property
    def size(self):
        return 1

    def penalties(self) -> list[np.ndarray]:
        return []


@dataclass(frozen=True)
class Smooth:
    """A smooth curve of one variable; ``cyclic`` joins its ends."""

    x: str
    k: int = 10
    cyclic: bool = False
    low: float | None = None
    high: float | None = None

    @property
    def name(self):
        return f"s({self.x})"

    @property
    def columns(self):
        return [self.x]

    @property
    def size(self):
        return self.k

    def prepare(self, stats, levels):
        low, high = stats[self.x]
        return replace(self, low=self.low if self.low is not None else low,
                       high=self.high if self.high is not None else high)

    def array(self) -> Column:
        make = B.cyclic_basis if self.cyclic else B.spline_basis
        return make(self.x, float(self.low), float(self.high), self.k)

    def penalties(self):
        eye = np.eye(self.k)
        d = (np.roll(eye, -1, axis=0) - 2 * eye + np.roll(eye, 1, axis=0)) if self.cyclic else np.diff(eye, 2, axis=0)
        return [d.T @ d]


@dataclass(frozen=True)
class Natural:
    """A natural cubic spline by its values at ``k`` quantiles of the variable, or at given knots.

    Its penalty is the exact curvature; ``shrink`` adds that share for what curvature leaves free, straight
    lines, so that a term that isn't needed shrinks to nothing.
    """

    x: str
    k: int = 10
    knots: tuple = ()
    shrink: float = 0.1

    @property
    def name(self):
        return f"s({self.x})"

    @property
    def columns(self):
        return [self.x]

    @property
    def size(self):
        return len(self.knots) or self.k

    def prepare(self, stats, levels):
        if self.knots:
            return self
        knots = tuple(sorted(set(stats[self.x, self.k])))
        if len(knots) < 3:
            raise ValueError(f"{self.x} has too few values for a natural spline")
        return replace(self, knots=knots)

    def array(self) -> Column:
        return B.natural_basis(self.x, self.knots)

    def penalties(self):
        _, curvature = B.natural_curvature(self.knots)
        values, vectors = np.linalg.eigh(curvature)
        free = values < values.max() * 1e-9
        # The free directions get a share of the least curvature that is penalised.
        return [curvature + self.shrink * values[~free].min() * vectors[:, free] @ vectors[:, free].T]


@dataclass(frozen=True)
class RandomIntercept:
    """A group effect shrunk towards zero."""

    group: str
    levels: tuple = ()

    @property
    def name(self):
        return f"re({self.group})"

    @property
    def columns(self):
        return [self.group]

    @property
    def size(self):
        return len(self.levels)

    def prepare(self, stats, levels):
        return replace(self, levels=tuple(levels[self.group]))

    def array(self) -> Column:
        return B.indicator_basis(self.group, self.levels)

    def penalties(self):
        return [np.eye(self.size)]


@dataclass(frozen=True)
class BySmooth:
    """One curve per group; ``shared`` uses one smoothing parameter for all groups."""

    smooth: Smooth
    group: str
    shared: bool = False
    levels: tuple = ()

    @property
    def name(self):
        return f"s({self.smooth.x},{self.group})" if self.shared else f"s({self.smooth.x}):{self.group}"

    @property
    def columns(self):
        return [self.smooth.x, self.group]

    @property
    def size(self):
        return self.smooth.k * len(self.levels)

    def prepare(self, stats, levels):
        return replace(self, smooth=self.smooth.prepare(stats, levels), levels=tuple(levels[self.group]))

    def array(self) -> Column:
        return B.by_group_basis(self.smooth.array(), self.smooth.k, self.group, self.levels)

    def penalties(self):
        (one,) = self.smooth.penalties()
        one = one + SHRINK * np.eye(self.smooth.k)
        n = len(self.levels)
        if self.shared:
            return [np.kron(np.eye(n), one)]
        return [np.kron(np.diag(np.eye(n)[i]), one) for i in range(n)]


@dataclass(frozen=True)
class Tensor:
    """Interaction of two variables without their main effects."""

    left: Smooth
    right: Smooth
    left_means: tuple = ()
    right_means: tuple = ()

    @property
    def name(self):
        return f"ti({self.left.x},{self.right.x})"

    @property
    def columns(self):
        return [self.left.x, self.right.x]

    @property
    def size(self):
        return self.left.k * self.right.k

    def prepare(self, stats, levels):
        return replace(self, left=self.left.prepare(stats, levels), right=self.right.prepare(stats, levels))

    def array(self) -> Column:
        a, b = self.left.array(), self.right.array()
        if self.left_means:
            a, b = B.centered(a, self.left_means), B.centered(b, self.right_means)
        return B.outer_basis(a, b)

    def penalties(self):
        (a,), (b,) = self.left.penalties(), self.right.penalties()
        return [np.kron(a, np.eye(self.right.k)), np.kron(np.eye(self.left.k), b)]


Term = Linear | Smooth | Natural | RandomIntercept | BySmooth | Tensor


def _seen(term) -> np.ndarray:
    """Projects coefficients of a term on the directions that its centred basis depends on."""
    def inner(k: int) -> np.ndarray:
        return np.eye(k) - 1 / k

    if isinstance(term, Tensor):
        return np.kron(inner(term.left.k), inner(term.right.k))
    return inner(term.size) if isinstance(term, Smooth | Natural) else np.eye(term.size)


# ------------------------------------------------------------------- model


@dataclass(frozen=True)
class AdditiveModel:
    """A fitted model: an intercept and centred terms."""

    y: str
    family: str
    terms: tuple
    means: tuple
    beta: np.ndarray
    cov: np.ndarray
    edf: np.ndarray
    lambdas: tuple
    n: int
    scale: float
    deviance: float
    null_deviance: float
    aic: float | None
    iterations: int
    slices: dict = field(default_factory=dict)
    converged: bool = True
    total_edf: float | None = None

    @property
    def log_link(self) -> bool:
        return self.family != GAUSSIAN

    @property
    def resid_df(self) -> float:
        """Degrees of freedom that the fit leaves."""
        return float(self.n - (self.edf.sum() if self.total_edf is None else self.total_edf))

    def row(self) -> Column:
        """The model matrix row: 1, then all centred term bases."""
        parts = [F.array(F.lit(1.0))]
        parts += [B.centered(t.array(), m) for t, m in zip(self.terms, self.means)]
        return F.concat(*parts)

    def term(self, name: str):
        for t, m in zip(self.terms, self.means):
            if t.name == name:
                return t, m
        raise KeyError(name)

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """``term, i, estimate, se``."""
        se = np.sqrt(np.maximum(np.diag(self.cov), 0.0))
        out = [("intercept", 0, float(self.beta[0]), float(se[0]))]
        for name, (a, b) in self.slices.items():
            out += [(name, j - a, float(self.beta[j]), float(se[j])) for j in range(a, b)]
        return spark.createDataFrame(out, "term string, i int, estimate double, se double")

    def term_table(self, spark: SparkSession) -> DataFrame:
        """Effective degrees of freedom, a Wald statistic and its p value per term.

        The statistic has as many degrees of freedom as the term effectively has; where the scale is
        estimated, its share per degree is compared with the F distribution.
        """
        out = []
        for t in self.terms:
            a, b = self.slices[t.name]
            # A centred basis doesn't tell coefficients from these plus a constant; only the ridge does.
            seen, name = _seen(t), t.name
            beta, cov = seen @ self.beta[a:b], seen @ self.cov[a:b, a:b] @ seen
            wald = float(beta @ np.linalg.pinv(cov, rcond=1e-8, hermitian=True) @ beta)
            edf = float(self.edf[a:b].sum())
            if self.family == POISSON:
                p = chi_squared_tail(wald, edf)
            else:
                p = f_tail(wald / max(edf, 1e-9), edf, self.resid_df)
            out.append((name, b - a, edf, wald, p))
        return spark.createDataFrame(out, "term string, size int, edf double, wald double, p double")


def describe(df: DataFrame, terms: Sequence[Term]):
    """Ranges of the smoothed variables and levels of the groups: two small results."""
    smooth, groups = set(), set()
    for t in terms:
        if isinstance(t, Tensor):
            smooth |= {t.left.x, t.right.x}
        elif isinstance(t, BySmooth):
            smooth.add(t.smooth.x)
            groups.add(t.group)
        elif isinstance(t, Smooth):
            smooth.add(t.x)
        elif isinstance(t, RandomIntercept):
            groups.add(t.group)
    stats = {}
    for t in terms:
        if isinstance(t, Natural) and not t.knots:
            value = F.col(t.x).cast("double")
            inner = F.percentile_approx(value, [i / (t.k - 1) for i in range(1, t.k - 1)], _KNOT_ACCURACY)
            row = df.agg(F.min(value), inner, F.max(value)).first()
            if row[0] is None:
                raise ValueError("no row has all inputs")
            stats[t.x, t.k] = [row[0], *row[1], row[2]]
    if smooth:
        names = sorted(smooth)
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{i}{f.__name__}") for i, c in enumerate(names)
                       for f in (F.min, F.max)]).first()
        if any(v is None for v in row):
            raise ValueError("no row has all inputs")
        stats |= {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(names)}
    levels = {}
    for g in sorted(groups):
        found = [x[0] for x in df.select(g).distinct().limit(MAX_COEFFICIENTS + 1).collect()]
        if len(found) > MAX_COEFFICIENTS:
            raise ValueError(f"{g} has more than {MAX_COEFFICIENTS} levels for one dense fit; fit_grouped takes any number")
        levels[g] = sorted(found)
    return stats, levels


def _array_sums(width: int):
    """Task side: the sum of one column of lists, and the number of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1)
        for batch in batches:
            total[:width] += matrix_of(batch.column(0), width).sum(axis=0)
            total[width] += batch.num_rows
        yield pa.RecordBatch.from_arrays([lists_of(total[None, :])], ["sums"])

    return run


def _column_means(df: DataFrame, arrays: Sequence[tuple[Column, int]]) -> list[tuple]:
    """Means of all elements of several array columns, in one pass."""
    if not arrays:
        return []
    width = sum(size for _, size in arrays)
    total = added_up(df.select(F.concat(*[a for a, _ in arrays]).alias("a")).mapInArrow(_array_sums(width), SUMS))
    if total is None or total[width] == 0:
        raise ValueError("no row has all inputs")
    means, out, at = (total[:width] / total[width]).tolist(), [], 0
    for _, size in arrays:
        out.append(tuple(means[at:at + size]))
        at += size
    return out


def _log_gamma(y: np.ndarray) -> np.ndarray:
    values, index = np.unique(y, return_inverse=True)
    return np.array([math.lgamma(v + 1.0) for v in values])[index]


def working(y: np.ndarray, eta: np.ndarray | None, family: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights and working responses at a linear predictor, and their sums as in ``Sums``; without one, where fitting begins."""
    if family == GAUSSIAN:
        w, z = np.ones_like(y), y
        fit = eta if eta is not None else np.zeros_like(y)
        deviance, log_lik = float(((y - fit) ** 2).sum()), 0.0
    else:
        if eta is None:
            mu = y + 0.5
            eta = np.log(mu)
        else:
            eta = np.clip(eta, -_MAX_LOG_MEAN, _MAX_LOG_MEAN)
            mu = np.exp(eta)
        w, z, fit = mu, eta + (y - mu) / mu, eta
        ratio = np.where(y > 0, y * np.log(np.where(y > 0, y, 1.0) / mu), 0.0)
        deviance = float(2 * (ratio - (y - mu)).sum())
        log_lik = float((y * eta - mu - _log_gamma(y)).sum())
    pearson = float((w * (z - fit) ** 2).sum())
    return w, z, np.array([float((w * z * z).sum()), len(y), deviance, log_lik, float(y.sum()), pearson])


def _accumulate(p: int, family: str, beta: list[float] | None):
    """Task side: one row of partial sums per partition.

    The sums are the upper triangle of X'WX, X'Wz, then z'Wz, n, deviance and log-likelihood at ``beta``,
    the sum of y and Pearson's statistic.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xwx, xwz, rest = np.zeros((p, p)), np.zeros(p), np.zeros(6)
        for batch in batches:
            x = matrix_of(batch.column(0), p)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            w, z, more = working(y, None if beta is None else x @ np.asarray(beta), family)
            xw = x * w[:, None]
            xwx += xw.T @ x
            xwz += xw.T @ z
            rest += more
        yield pa.RecordBatch.from_arrays([lists_of(np.concatenate([packed(xwx), xwz, rest])[None, :])], ["sums"])

    return run


@dataclass
class Sums:
    xwx: np.ndarray
    xwz: np.ndarray
    zwz: float
    n: float
    deviance: float
    log_lik: float
    y_sum: float
    pearson: float

    @classmethod
    def unpack(cls, flat: np.ndarray, p: int) -> Sums:
        tri = triangle_size(p)
        return cls(unpacked(flat[:tri], p), flat[tri:tri + p], *flat[tri + p:])


def _sums(design: DataFrame, p: int, family: str, beta) -> Sums:
    flat = added_up(design.mapInArrow(_accumulate(p, family, beta), SUMS))
    return Sums.unpack(np.zeros(triangle_size(p) + p + 6) if flat is None else flat, p)


def _ridge(xwx: np.ndarray) -> np.ndarray:
    """What keeps directions without data, such as the constant of a centred basis, from being singular; the intercept has none."""
    sizes = np.diag(xwx)[1:].copy()
    # A coefficient that no row informs takes the size of the others.
    sizes[sizes <= 0] = sizes.mean() if sizes.any() else 1.0
    return np.diag([0.0, *_RIDGE * sizes])


def _inverse(a: np.ndarray) -> np.ndarray:
    """The inverse of a penalised cross-product, scaled to a unit diagonal.

    A large penalty swallows the ridge of directions that hold neither data nor penalty, such as the constant of a
    centred basis. What is left of them is rounding; they count as the smallest size that rounding leaves.
    """
    diagonal = np.diag(a)
    scale = 1.0 / np.sqrt(np.where(diagonal > 0, diagonal, 1.0))
    sizes, directions = np.linalg.eigh(a * np.outer(scale, scale))
    sizes = np.maximum(sizes, len(a) * np.finfo(float).eps * sizes[-1])
    directions = directions * scale[:, None]
    return (directions / sizes) @ directions.T


def _solve(s: Sums, penalties: list[np.ndarray], lambdas: Sequence[float]):
    a = s.xwx + sum((lam * pen for lam, pen in zip(lambdas, penalties)), np.zeros_like(s.xwx))
    a = a + _ridge(s.xwx)
    inverse = _inverse(a)
    return inverse @ s.xwz, inverse, inverse @ s.xwx


def _stepped(lambdas, penalties, blocks, beta, inverse, phi: float) -> list[float]:
    """One step of the generalised Fellner-Schall rule (Wood and Fasiolo 2017)."""
    new = list(lambdas)
    for (a, b), members in blocks:
        total = sum(lambdas[j] * penalties[j][a:b, a:b] for j in members)
        inner = np.linalg.pinv(total, rcond=1e-10, hermitian=True)
        for j in members:
            pen = penalties[j][a:b, a:b]
            gain = np.sum(inner * pen) - np.sum(inverse[a:b, a:b] * pen)
            cost = beta[a:b] @ pen @ beta[a:b]
            step = phi * max(gain, 1e-12) / max(cost, 1e-12 * np.trace(pen) * phi)
            new[j] = float(np.clip(lambdas[j] * step, *LAMBDA_RANGE))
    return new


def _choose(s: Sums, penalties, blocks, lambdas: list[float], family: str) -> tuple[list[float], bool]:
    """Smoothing parameters by restricted maximum likelihood, and whether they have settled.

    A step moves all parameters at once at the price of one solve.
    """
    for _ in range(MAX_UPDATES):
        beta, inverse, hat = _solve(s, penalties, lambdas)
        rss = max(s.zwz - 2 * beta @ s.xwz + beta @ s.xwx @ beta, 1e-300)
        phi = 1.0 if family == POISSON else rss / max(s.n - np.trace(hat), 1.0)
        new = _stepped(lambdas, penalties, blocks, beta, inverse, phi)
        moved = max((abs(math.log(n / o)) for n, o in zip(new, lambdas)), default=0.0)
        lambdas = new
        if moved < 0.01:
            return lambdas, True
    return lambdas, False


@dataclass(frozen=True)
class Border:
    """Prepared terms: their means, places and penalties among the coefficients, the intercept first."""

    terms: tuple
    means: tuple
    slices: dict
    penalties: list
    blocks: list
    p: int

    def row(self) -> Column:
        return self.model("", GAUSSIAN).row()

    def model(self, y: str, family: str) -> AdditiveModel:
        """A model that hasn't been fitted."""
        p = self.p
        return AdditiveModel(y, family, self.terms, self.means, np.zeros(p), np.zeros((p, p)), np.zeros(p), (), 0, 1.0, 0.0, 0.0, None, 0, self.slices)

    def scales(self, xwx: np.ndarray) -> list[float]:
        """For each penalty, the size of the data that it acts on."""
        return [
            max(np.trace(xwx * (np.abs(pen).sum(axis=0) > 0)) / max(np.trace(pen), 1e-300), 1e-12) for pen in self.penalties
        ]

    def penalty(self, lambdas: Sequence[float]) -> np.ndarray:
        return sum((lam * pen for lam, pen in zip(lambdas, self.penalties)), np.zeros((self.p, self.p)))

    def ridge(self, xwx: np.ndarray) -> np.ndarray:
        return _ridge(xwx)

    def free(self, inverse: np.ndarray, lambdas: Sequence[float], xwx: np.ndarray) -> np.ndarray:
        """Degrees of freedom that penalties and ridge leave the coefficients."""
        return 1.0 - np.einsum("ij,ji->i", inverse, self.penalty(lambdas) + self.ridge(xwx))

    def step(self, lambdas, beta, inverse, phi: float) -> list[float]:
        return _stepped(lambdas, self.penalties, self.blocks, beta, inverse, phi)


def prepare_border(rows: DataFrame, terms: Sequence[Term]) -> Border:
    """Find ranges, levels and means of terms on rows without missing values."""
    stats, levels = describe(rows, terms)
    ready = [t.prepare(stats, levels) for t in terms]
    tensors = [i for i, t in enumerate(ready) if isinstance(t, Tensor)]
    marginals = [(s.array(), s.k) for i in tensors for s in (ready[i].left, ready[i].right)]
    found = _column_means(rows, marginals)
    for j, i in enumerate(tensors):
        ready[i] = replace(ready[i], left_means=found[2 * j], right_means=found[2 * j + 1])
    means = _column_means(rows, [(t.array(), t.size) for t in ready])
    p = 1 + sum(t.size for t in ready)
    if p > MAX_COEFFICIENTS:
        raise ValueError(f"{p} coefficients are too many for one dense fit; fit_grouped takes a grouping of any number of levels")
    slices, penalties, blocks, at = {}, [], [], 1
    for t in ready:
        slices[t.name] = (at, at + t.size)
        first = len(penalties)
        for small in t.penalties():
            full = np.zeros((p, p))
            full[at:at + t.size, at:at + t.size] = small
            penalties.append(full)
        if len(penalties) > first:
            blocks.append((slices[t.name], range(first, len(penalties))))
        at += t.size
    return Border(tuple(ready), tuple(means), slices, penalties, blocks, p)


def fit_additive(
    df: DataFrame,
    y: str,
    terms: Sequence[Term],
    family: str = GAUSSIAN,
    lambdas: Sequence[float] | None = None,
    max_iter: int = 25,
    tol: float = 1e-8,
) -> AdditiveModel:
    """Fit ``y`` by an intercept and terms; rows with a missing input are left out.

    ``lambdas`` fixes the smoothing parameters, one per penalty in term order;
    otherwise they are chosen. Pin ``df`` first if it is costly to compute,
    since every iteration reads it again. ``converged`` says whether the iterations and the
    choice ended by themselves, not by ``max_iter`` or the limit on updates.
    """
    inputs = sorted({c for t in terms for c in t.columns})
    rows = df.select(y, *[c for c in inputs if c != y]).dropna()
    border = prepare_border(rows, terms)
    shell, p, penalties, blocks = border.model(y, family), border.p, border.penalties, border.blocks
    design = rows.select(shell.row().alias("x"), F.col(y).cast("double").alias("y"))

    # Penalties on the scale of the data they act on, so that one grid fits all.
    s = _sums(design, p, family, None)
    if s.n == 0:
        raise ValueError("no row has all inputs")
    scaled = [pen * size for pen, size in zip(penalties, border.scales(s.xwx))]
    chosen, settled = (list(lambdas), True) if lambdas is not None else _choose(s, scaled, blocks, [1.0] * len(scaled), family)
    beta, inverse, hat = _solve(s, scaled, chosen)
    iterations, converged, final = 1, settled, None
    if family != GAUSSIAN:
        converged, held = False, None
        penalised = lambda sums, at: sums.deviance + at @ sum((lam * pen for lam, pen in zip(chosen, scaled)), np.zeros((p, p))) @ at
        for iterations in range(2, max_iter + 1):
            s = _sums(design, p, family, beta.tolist())
            if held is not None:
                old, before, deviance = held
                halved = 0
                # A step that makes the fit worse is halved until it doesn't.
                while not penalised(s, beta) <= before + 1e-7 * (abs(before) + 0.1) and halved < _MAX_HALVINGS:
                    beta, halved = (beta + old) / 2, halved + 1
                    s = _sums(design, p, family, beta.tolist())
                if abs(deviance - s.deviance) <= tol * (abs(s.deviance) + 0.1):
                    converged = settled
                    break
            # After a few steps the weights barely move; keep the choice and let it converge.
            if lambdas is None and iterations <= 6:
                chosen, settled = _choose(s, scaled, blocks, chosen, family)
            held = beta, penalised(s, beta), s.deviance
            beta, inverse, hat = _solve(s, scaled, chosen)
        else:
            # The sums are of the coefficients before the last step.
            final = _sums(design, p, family, beta.tolist())
    if final is None:
        final = s if family != GAUSSIAN else _sums(design, p, family, beta.tolist())
    edf = np.diag(hat).copy()
    scale, aic = scale_and_aic(family, final, final.deviance, float(edf.sum()))
    return replace(
        shell, beta=beta, cov=inverse * scale, edf=edf, lambdas=tuple(chosen), n=int(final.n), scale=scale,
        deviance=final.deviance, null_deviance=null_deviance(rows, y, family), aic=aic, iterations=iterations, converged=converged,
        total_edf=float(edf.sum()),
    )


def scale_and_aic(family: str, s: Sums, deviance: float, edf: float) -> tuple[float, float | None]:
    free = max(s.n - edf, 1.0)
    if family == GAUSSIAN:
        return deviance / free, s.n * (math.log(2 * math.pi * deviance / s.n) + 1) + 2 * (edf + 1)
    if family == POISSON:
        return 1.0, -2 * s.log_lik + 2 * edf
    return s.pearson / free, None


def null_deviance(rows: DataFrame, y: str, family: str) -> float:
    v = F.col(y).cast("double")
    if family == GAUSSIAN:
        return rows.agg((F.var_pop(v) * F.count(v)).alias("d")).first()["d"]
    row = rows.agg(F.sum(F.when(v > 0, v * F.log(v)).otherwise(0.0)).alias("a"), F.sum(v).alias("s"),
                   F.count(v).alias("n")).first()
    return 2 * (row["a"] - row["s"] * math.log(row["s"] / row["n"])) if row["s"] else 0.0


# ------------------------------------------------------------------ scoring


def score(df: DataFrame, model: AdditiveModel, type: str = "response", se: bool = False) -> DataFrame:
    """Add ``fit`` (and ``se``) on the link or response scale, for old or new rows.

    Rows with a missing input get a missing fit.
    """
    known = F.lit(True)
    for c in sorted({c for t in model.terms for c in t.columns}):
        known = known & F.col(c).isNotNull()
    response = model.log_link and type == "response"
    if not se:
        eta = B.dot(model.row(), model.beta)
        return df.withColumn("fit", F.when(known, F.exp(eta) if response else eta))
    scored = _linear(df, model.row(), model.beta, model.cov, "fit")
    fit = F.when(known, F.exp("fit") if response else F.col("fit"))
    err = F.when(known, F.exp("fit") * F.col("se") if response else F.col("se"))
    return scored.withColumns({"fit": fit, "se": err})


def _linear(df: DataFrame, row: Column, beta: np.ndarray, cov: np.ndarray, out: str) -> DataFrame:
    """Add ``out``, the product of a design row and coefficients, and its ``se``; missing where the row is."""
    weights, spread, p = beta.tolist(), cov.tolist(), len(beta)
    names = [*df.columns, out, "se"]
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType()), T.StructField("se", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, v = np.asarray(weights), np.asarray(spread)
        for batch in batches:
            rows = batch.column(batch.num_columns - 1)
            known = np.asarray(rows.is_valid())
            x = np.zeros((len(rows), p))
            x[known] = rows.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            se = np.sqrt(np.maximum(np.einsum("ij,ij->i", x @ v, x), 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x @ b, mask=~known), pa.array(se, mask=~known)], names)

    return df.withColumn("_row", row).mapInArrow(run, schema)


def with_interval(df: DataFrame) -> DataFrame:
    """Add ``LCI`` and ``UCI`` to a table with ``fit`` and ``se``."""
    low, high = normal_interval("fit", "se")
    return df.withColumns({"LCI": low, "UCI": high})


def residuals(df: DataFrame, model: AdditiveModel) -> DataFrame:
    """Add ``fit`` and ``resid``: plain, or deviance residuals for counts."""
    scored = score(df, model)
    y, fit = F.col(model.y).cast("double"), F.col("fit")
    if not model.log_link:
        return scored.withColumn("resid", y - fit)
    ratio = F.when(y > 0, y * F.log(y / fit)).otherwise(0.0)
    return scored.withColumn(
        "resid", F.signum(y - fit) * F.sqrt(F.greatest(F.lit(0.0), 2 * (ratio - (y - fit))))
    )


def observed_vs_predicted(df: DataFrame, model: AdditiveModel, keep: Sequence[str] = ()) -> DataFrame:
    return score(df, model).select(*keep, F.col(model.y).alias("observed"), F.col("fit").alias("predicted"))


def fit_summary(df: DataFrame, model: AdditiveModel) -> DataFrame:
    """One row: n, edf, adjusted R squared, deviance explained, scale, AIC."""
    y = F.col(model.y).cast("double")
    scored = score(df.dropna(subset=[model.y, *{c for t in model.terms for c in t.columns}]), model)
    edf = float(model.edf.sum())
    sums = scored.agg(
        F.count(y).alias("n"), F.var_samp(y).alias("_var"), F.sum((y - F.col("fit")) * (y - F.col("fit"))).alias("_rss")
    )
    return sums.select(
        "n", F.lit(edf).alias("edf"),
        (1 - F.col("_rss") / (F.col("n") - edf) / F.col("_var")).alias("adj_r2"),
        F.lit(1 - model.deviance / model.null_deviance).alias("deviance_explained"),
        F.lit(model.scale).alias("scale"), F.lit(model.aic).cast("double").alias("aic"),
    )


def compare_models(spark: SparkSession, models: dict[str, AdditiveModel]) -> DataFrame:
    """One row per model, least criterion first where there is one."""
    out = [
        (name, m.family, m.n, float(m.edf.sum()), float(m.deviance), float(1 - m.deviance / m.null_deviance),
         None if m.aic is None else float(m.aic))
        for name, m in models.items()
    ]
    schema = "model string, family string, n long, edf double, deviance double, deviance_explained double, aic double"
    return spark.createDataFrame(out, schema).orderBy(F.col("aic").asc_nulls_last(), "deviance")


def nested_tests(spark: SparkSession, models: Sequence[tuple[str, AdditiveModel]]) -> DataFrame:
    """Each model against the one before it, whose terms it must hold: ``model, resid_df, deviance, df, difference, statistic, p``.

    The first row has no test. Differences of deviance are compared with the chi-squared distribution for
    Poisson responses, else, per degree of freedom and scale of the larger model, with the F distribution.
    """
    out, before = [], None
    for name, m in models:
        test = (None, None, None, None)
        if before is not None:
            if (m.y, m.family, m.n) != (before.y, before.family, before.n):
                raise ValueError(f"{name} is not fitted to the rows of the model before it")
            df, difference = before.resid_df - m.resid_df, before.deviance - m.deviance
            if m.family == POISSON:
                statistic, p = difference, chi_squared_tail(difference, df)
            else:
                statistic = difference / df / m.scale if df > 0 else None
                p = None if statistic is None else f_tail(statistic, df, m.resid_df)
            test = tuple(None if v is None else float(v) for v in (df, difference, statistic, p))
        out.append((name, m.resid_df, float(m.deviance), *test))
        before = m
    return spark.createDataFrame(out, "model string, resid_df double, deviance double, df double, difference double, statistic double, p double")


def residual_check(df: DataFrame, model: AdditiveModel, keys: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Mean and variance of residuals by tenth of the fitted values.

    With ``order`` it adds the correlation of neighbouring residuals within ``keys``
    (a bounded series per key).
    """
    resid = residuals(df, model)
    cuts = resid.agg(F.percentile_approx("fit", [i / 10 for i in range(1, 10)], 10_000).alias("c")).first()["c"] or []
    tenth = sum([(F.col("fit") > c).cast("int") for c in cuts], F.lit(1))
    aggregates = [
        F.count("resid").alias("n"), F.avg("fit").alias("mean_fit"),
        F.avg("resid").alias("mean_resid"), F.var_samp("resid").alias("var_resid"),
    ]
    if order:
        w = Window.partitionBy(*keys).orderBy(*order)
        resid = resid.withColumn("_before", F.lag("resid").over(w))
        aggregates.append(F.corr("resid", "_before").alias("lag_corr"))
    return resid.groupBy(tenth.alias("tenth")).agg(*aggregates)


# ------------------------------------------------------------------ effects


def _term_columns(df: DataFrame, model: AdditiveModel, names: Sequence[str]) -> DataFrame:
    """Add ``effect`` and ``se``: the joint contribution of some terms, centred."""
    index, parts = [], []
    for name in names:
        t, means = model.term(name)
        parts.append(B.centered(t.array(), means))
        index += list(range(*model.slices[name]))
    return _linear(df, F.concat(*parts), model.beta[index], model.cov[np.ix_(index, index)], "effect")


def _grid(df: DataFrame, x: str, points: int, out: str | None = None) -> DataFrame:
    """``points`` equal steps over the range of a column, from one aggregate row."""
    ends = df.agg(F.min(x).cast("double").alias("_lo"), F.max(x).cast("double").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / (points - 1)
    spine = ends.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return spine.select((F.col("_lo") + F.col("_i") * step).alias(out or x))


def partial_effect(df: DataFrame, model: AdditiveModel, name: str, points: int = 100) -> DataFrame:
    """One term's curve over the range of its variable: ``x, effect, se, LCI, UCI``."""
    t, _ = model.term(name)
    grid = _term_columns(_grid(df, t.columns[0], points), model, [name])
    low, high = normal_interval("effect", "se")
    return grid.withColumns({"LCI": low, "UCI": high})


def partial_residuals(df: DataFrame, model: AdditiveModel, name: str) -> DataFrame:
    """Each row's contribution of a term, and that plus its working residual."""
    resid = residuals(df, model)
    fit = F.col("fit")
    working = (F.col(model.y) - fit) / fit if model.log_link else F.col(model.y) - fit
    return _term_columns(resid, model, [name]).withColumn("partial", F.col("effect") + working)


def effect_surface(
    df: DataFrame, model: AdditiveModel, x1: str, x2: str, points: int = 30, too_far: float = 0.1
) -> DataFrame:
    """The linear predictor of all terms in ``x1`` and ``x2`` on a grid, away from data left out.

    A cell stays if some row lies within ``too_far`` of it, both ranges scaled to 1.
    Each row visits only the cells near it.
    """
    names = [t.name for t in model.terms if set(t.columns) <= {x1, x2}]
    ends = df.agg(*[f(c).cast("double").alias(f"_{n}{i}") for i, c in enumerate((x1, x2))
                    for n, f in (("lo", F.min), ("hi", F.max))]).first()
    (lo1, hi1, lo2, hi2), top = ends, points - 1
    reach = math.ceil(too_far * top)

    def scaled(c, lo, hi):
        return (F.col(c) - lo) / (hi - lo) if hi > lo else F.lit(0.0)

    near = df.select(scaled(x1, lo1, hi1).alias("_u"), scaled(x2, lo2, hi2).alias("_v")).dropna()
    for axis, cell in (("_u", "_i"), ("_v", "_j")):
        middle = F.round(F.col(axis) * top).cast("int")
        near = near.withColumn(cell, F.explode(F.sequence(
            F.greatest(F.lit(0), middle - reach), F.least(F.lit(top), middle + reach)
        )))
    du, dv = F.col("_u") - F.col("_i") / top, F.col("_v") - F.col("_j") / top
    cells = near.where(du * du + dv * dv <= too_far * too_far).select("_i", "_j").distinct()
    grid = cells.select(
        (F.lit(lo1) + F.col("_i") * ((hi1 - lo1) / top)).alias(x1),
        (F.lit(lo2) + F.col("_j") * ((hi2 - lo2) / top)).alias(x2),
    )
    surface = _term_columns(grid, model, names)
    return surface.withColumn("link", F.col("effect") + float(model.beta[0])).drop("effect")


# ------------------------------------------------------- regression, peaks


def fit_linear(df: DataFrame, y: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """Straight-line fit per group: ``n, intercept, slope, se_slope, r2, rss``."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    fit = df.where(both).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"),
        F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"),
    )
    rss = F.col("_syy") - F.col("slope") * F.col("_sxy")
    return fit.select(
        *keys, "n", "intercept", "slope",
        F.sqrt(F.try_divide(rss, (F.col("n") - 2) * F.col("_sxx"))).alias("se_slope"), "r2", rss.alias("rss"),
    )


def score_linear(df: DataFrame, fits: DataFrame, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``fit`` from a table of straight lines."""
    lines = fits.select(*keys, "intercept", "slope")
    return attach(df, lines, keys, measured=True).withColumn("fit", F.col("intercept") + F.col("slope") * F.col(x)).drop(
        "intercept", "slope"
    )


def phenology_peak(
    pred: DataFrame, keys: Sequence[str], doy: str, fit: str, tails: tuple[float, float] = (0.025, 0.975)
) -> DataFrame:
    """Day of the highest fitted value, and the days at which the cumulative share
    of the fitted total first reaches the tails; one row per day and group."""
    w = Window.partitionBy(*keys).orderBy(doy)
    share = F.sum(fit).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(fit).over(
        Window.partitionBy(*keys)
    )
    cumulated = pred.withColumn("_share", share)
    # First day among ties, and the comparison tolerates the last bits of the sum.
    reached = [F.min(F.when(F.col("_share") >= t - 1e-12, F.col(doy))) for t in tails]
    return cumulated.groupBy(*keys).agg(
        F.max_by(doy, F.when(F.col(fit).isNotNull(), F.struct(F.col(fit), -F.col(doy)))).alias("peak"),
        reached[0].alias("lower"), reached[1].alias("upper"),
    )
