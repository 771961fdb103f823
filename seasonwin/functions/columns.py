"""Scalar column functions with the missing-value rules of statistical tables.

A missing input gives a missing output unless a function says otherwise;
``when/otherwise`` alone would turn it into the "else" value.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The day-length model of Forsythe et al. (1995), with the sun's
# centre 0.8333 degrees below the horizon at sunrise and sunset.
_REVOLUTION = (0.2163108, 0.9671396, 0.0086, 186)
_DECLINATION = 0.39795
_HORIZON_DEGREES = 0.8333

NORMAL_95 = 1.96


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_known(c: Column | str, condition: Column, yes, no) -> Column:
    """``yes``/``no`` by ``condition``, but missing where ``c`` is missing."""
    return F.when(col(c).isNotNull(), F.when(condition, yes).otherwise(no))


def recode(c: Column | str, labels: Mapping[str, Sequence], default=None) -> Column:
    """Map many raw codes to few labels; codes are compared as text."""
    text = col(c).cast("string")
    out = F.lit(default).cast("string")
    for label, codes in reversed(list(labels.items())):
        out = F.when(text.isin([str(x) for x in codes]), F.lit(label)).otherwise(out)
    return out


def hinge(c: Column | str, threshold: float = 0.0, inclusive: bool = False) -> Column:
    """The value itself above ``threshold`` and 0 below (not the excess)."""
    c = col(c)
    above = c >= threshold if inclusive else c > threshold
    return if_known(c, above, c, F.lit(0.0))


def flag_between(
    c: Column | str,
    low: Column | str,
    high: Column | str,
    pad_low: int = 0,
    pad_high: int = 0,
    inside: str = "ice",
    outside: str = "open",
) -> Column:
    """Label dates inside ``[low - pad_low, high + pad_high]``."""
    hit = (col(c) >= F.date_sub(col(low), pad_low)) & (col(c) <= F.date_add(col(high), pad_high))
    return F.when(hit, F.lit(inside)).when(~hit, F.lit(outside))


def flag_positive(c: Column | str, yes: str = "Open", no: str = "Ice") -> Column:
    return if_known(c, col(c) > 0, F.lit(yes), F.lit(no))


def bucket_ranges(c: Column | str, ranges: Sequence[tuple], default: str | None = None) -> Column:
    """Label by closed ranges ``(low, high, label)``; first match wins, and what is in none, or missing, gets the default."""
    c = col(c)
    out = F.lit(default).cast("string")
    for low, high, label in reversed(list(ranges)):
        out = F.when(c.between(low, high), F.lit(label)).otherwise(out)
    return out


def season_year(date: Column | str, start_month: int = 7) -> Column:
    """Year a cold season ends in: months from ``start_month`` count as next year."""
    date = col(date)
    return F.year(date) + F.when(F.month(date) >= start_month, 1).otherwise(0)


def prefer_observed(observed: Column | str, predicted: Column | str) -> Column:
    """The observation when positive, the prediction when it is zero or below."""
    return if_known(observed, col(observed) > 0, col(observed), col(predicted))


def power_terms(c: Column | str, degree: int = 2) -> list[Column]:
    """``[c, c*c, ...]`` up to ``degree``, by multiplication."""
    c = col(c)
    return [reduce(lambda a, b: a * b, [c] * d) for d in range(1, degree + 1)]


def null_where(c: Column | str, condition: Column) -> Column:
    """Blank a value where ``condition`` holds; an unknown condition keeps it."""
    return F.when(~F.coalesce(condition, F.lit(False)), col(c))


def nan_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def parse_date(c: Column | str, fmt: str = "M/d/y") -> Column:
    """Date from text; unreadable text is missing instead of an error."""
    return F.try_to_date(col(c), fmt)


def row_mean(*cols: Column | str) -> Column:
    """Mean across columns, skipping missing ones; missing when all are."""
    cs = [col(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cs])
    known = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cs])
    return F.try_divide(total.cast("double"), known)


def log_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Natural log of a ratio; missing unless both sides are positive."""
    a, b = col(numerator), col(denominator)
    return F.when((a > 0) & (b > 0), F.log(a / b))


def day_number(date: Column | str) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(col(date).cast("date"))


def day_of_year(date: Column | str) -> Column:
    return F.dayofyear(col(date))


def date_from_doy(year: Column | str, doy: Column | str) -> Column:
    """Date of a day of year, counted from Dec 31 of the year before."""
    return F.date_add(F.make_date(col(year) - 1, F.lit(12), F.lit(31)), col(doy).cast("int"))


def daylength(latitude: float, doy: Column | str) -> Column:
    """Hours between sunrise and sunset at ``latitude`` on a day of year."""
    offset, ratio, rate, solstice = _REVOLUTION
    revolution = F.lit(offset) + 2 * F.atan(F.lit(ratio) * F.tan(F.lit(rate) * (col(doy) - solstice)))
    declination = F.asin(F.lit(_DECLINATION) * F.cos(revolution))
    lat = math.radians(latitude)
    hour_angle = (
        F.lit(math.sin(math.radians(_HORIZON_DEGREES))) + F.lit(math.sin(lat)) * F.sin(declination)
    ) / (F.lit(math.cos(lat)) * F.cos(declination))
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), hour_angle))
    return F.when(col(doy).isNotNull(), F.lit(24.0) - F.lit(24.0 / math.pi) * F.acos(clamped))


def normal_interval(fit: Column | str, se: Column | str, z: float = NORMAL_95) -> tuple[Column, Column]:
    """Lower and upper end of ``fit`` plus or minus ``z`` standard errors."""
    return col(fit) - z * col(se), col(fit) + z * col(se)
