"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c: Column | str, places: int = 6) -> Column:
    """Round for reporting; adding zero folds minus zero into zero."""
    return F.round(c, places) + F.lit(0.0)


def exact_mean(c: Column | str) -> Column:
    """Mean from a sum of decimals (twelve places), which no order of the rows changes."""
    col = F.col(c) if isinstance(c, str) else c
    return F.sum(col.cast("decimal(28,12)")).cast("double") / F.count(col)


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp column (session zone is UTC)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(col.cast("timestamp"))


def seconds(c: Column | str) -> Column:
    return micros(c) / F.lit(1e6)


def norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def half_away(c: Column) -> Column:
    """Nearest whole number, halves away from zero."""
    return F.signum(c) * F.floor(F.abs(c) + 0.5)
