"""Spline bases as array columns.

Cubic B-splines on equidistant knots are, together with a difference penalty, the P-splines of
Eilers and Marx (1996). Natural cubic splines are given by their values at any knots, and their penalty is the
integral of the squared second derivative (Wood 2017, 5.3.1). A basis needs no state but its range or knots, so it is a plain expression.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from seasonwin.functions.columns import col


def _bump(u: Column) -> Column:
    """The cardinal cubic B-spline at distance ``u >= 0`` from its centre."""
    inner = (4 - 6 * u * u + 3 * u * u * u) / 6
    outer = (2 - u) * (2 - u) * (2 - u) / 6
    return F.when(u < 1, inner).when(u < 2, outer).otherwise(0.0)


def spline_basis(x: Column | str, low: float, high: float, k: int) -> Column:
    """``k`` basis functions over ``[low, high]``; values outside count as the nearer end, missing ones have none."""
    if k < 4:
        raise ValueError("a cubic basis has at least 4 functions")
    step = (high - low) / (k - 3)
    inside = F.greatest(F.lit(low), F.least(F.lit(high), col(x).cast("double")))
    bumps = [_bump(F.abs(inside - F.lit(low + (i - 1) * step)) / F.lit(step)) for i in range(k)]
    return F.when(col(x).isNotNull(), F.array(*bumps))


def cyclic_basis(x: Column | str, low: float, high: float, k: int) -> Column:
    """``k`` basis functions of period ``high - low``; values outside are wrapped, missing ones have none."""
    if k < 4:
        raise ValueError("a cubic basis has at least 4 functions")
    period = high - low
    step = period / k
    bumps = []
    for i in range(k):
        away = F.pmod(col(x).cast("double") - F.lit(low + i * step), F.lit(period))
        bumps.append(_bump(F.least(away, F.lit(period) - away) / F.lit(step)))
    return F.when(col(x).isNotNull(), F.array(*bumps))


def natural_curvature(knots: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """For a natural cubic spline by its values at knots: the matrix that gives its second derivatives there, and the penalty.

    Both follow from the banded systems that continuous first derivatives set up.
    """
    h = np.diff(np.asarray(knots, float))
    k = len(h) + 1
    d, b = np.zeros((k - 2, k)), np.zeros((k - 2, k - 2))
    for i in range(k - 2):
        d[i, i:i + 3] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
        b[i, i] = (h[i] + h[i + 1]) / 3
        if i:
            b[i, i - 1] = b[i - 1, i] = h[i] / 6
    inner = np.linalg.solve(b, d)
    return np.vstack([np.zeros(k), inner, np.zeros(k)]), d.T @ inner


def natural_basis(x: Column | str, knots: Sequence[float]) -> Column:
    """One function per knot, 1 there and 0 at the others; values outside count as the nearer end, missing ones have none."""
    knots = [float(v) for v in knots]
    if len(knots) < 3 or any(b <= a for a, b in zip(knots, knots[1:])):
        raise ValueError("a natural spline has at least 3 rising knots")
    second, _ = natural_curvature(knots)
    inside = F.greatest(F.lit(knots[0]), F.least(F.lit(knots[-1]), col(x).cast("double")))
    at = F.array(*map(F.lit, knots))
    # The knot that begins the interval of x; the last interval has both its ends.
    j = sum([(inside >= v).cast("int") for v in knots[1:-1]], F.lit(0))
    curves = F.array(*[F.array(*map(F.lit, map(float, row))) for row in second])
    place = F.struct(j.alias("j"), inside.alias("x"), F.get(at, j).alias("low"), F.get(at, j + 1).alias("high"))

    def values(p: Column) -> Column:
        h, left, right = p["high"] - p["low"], p["high"] - p["x"], p["x"] - p["low"]
        bend_left, bend_right = (left * left * left / h - h * left) / 6, (right * right * right / h - h * right) / 6
        return F.transform(F.sequence(F.lit(0), F.lit(len(knots) - 1)), lambda i: (
            F.when(i == p["j"], left / h).when(i == p["j"] + 1, right / h).otherwise(0.0)
            + bend_left * F.get(F.get(curves, p["j"]), i) + bend_right * F.get(F.get(curves, p["j"] + 1), i)
        ))

    return F.when(col(x).isNotNull(), F.get(F.transform(F.array(place), values), F.lit(0)))


def indicator_basis(group: Column | str, levels: Sequence) -> Column:
    """One 0/1 element per level."""
    return F.array(*[F.when(col(group) == F.lit(v), 1.0).otherwise(0.0) for v in levels])


def by_group_basis(basis: Column, size: int, group: Column | str, levels: Sequence) -> Column:
    """A copy of ``basis`` per level, zero on the rows of other levels."""
    empty = F.array(*[F.lit(0.0)] * size)
    return F.concat(*[F.when(col(group) == F.lit(v), basis).otherwise(empty) for v in levels])


def outer_basis(left: Column, right: Column) -> Column:
    """All products of two bases, the right index running fastest."""
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: a * b)))


def centered(basis: Column, means: Sequence[float]) -> Column:
    """The basis less its column means."""
    shift = F.array(*[F.lit(float(m)) for m in means])
    return F.zip_with(basis, shift, lambda a, b: a - b)


def dot(basis: Column, coefficients: Sequence[float]) -> Column:
    weights = F.array(*[F.lit(float(b)) for b in coefficients])
    return F.aggregate(F.zip_with(basis, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def products(left: Column, right: Column) -> Column:
    """The sum of products of two arrays, element by element; missing if one of them is."""
    return F.when(left.isNotNull() & right.isNotNull(), F.aggregate(
        F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v
    ))
