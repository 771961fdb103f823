"""Upper tails of the chi-squared and F distributions, for the few test statistics of a fitted model."""

from __future__ import annotations

import math

_STEPS, _EXACT, _TINY = 10_000, 1e-15, 1e-300


def _continued(first: float, terms) -> float:
    """A continued fraction first + a1 / (b1 + a2 / (b2 + ...)) by the recurrence of its two-sided ratios."""
    value = ratio = first or _TINY
    inverse = 0.0
    for a, b in terms:
        inverse = 1 / ((b + a * inverse) or _TINY)
        ratio = (b + a / ratio) or _TINY
        value *= ratio * inverse
        if abs(ratio * inverse - 1) < _EXACT:
            break
    return value


def chi_squared_tail(x: float, df: float) -> float:
    """The chance that a chi-squared variable with ``df`` degrees of freedom exceeds ``x``."""
    if x <= 0 or df <= 0:
        return 1.0
    a, half = df / 2, x / 2
    scale = math.exp(a * math.log(half) - half - math.lgamma(a))
    if half < a + 1:
        term = total = 1 / a
        for i in range(1, _STEPS):
            term *= half / (a + i)
            total += term
            if term < total * _EXACT:
                break
        return max(0.0, 1 - scale * total)
    fraction = _continued(half + 1 - a, ((i * (a - i), half + 2 * i + 1 - a) for i in range(1, _STEPS)))
    return scale / fraction


def _beta_share(x: float, a: float, b: float) -> float:
    """The incomplete beta function up to ``x``, as a share of the whole."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)

    def terms():
        for m in range(_STEPS):
            if m:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    log_scale = a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return math.exp(log_scale) / (a * _continued(1.0, terms()))


def f_tail(x: float, df1: float, df2: float) -> float:
    """The chance that an F variable with ``df1`` and ``df2`` degrees of freedom exceeds ``x``."""
    if x <= 0 or df1 <= 0 or df2 <= 0:
        return 1.0
    return _beta_share(df2 / (df2 + df1 * x), df2 / 2, df1 / 2)
