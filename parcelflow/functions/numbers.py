"""Guarded arithmetic: the ANSI default raises on a zero divisor, these return null or a default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,12)"


def safe_corr(left: str, right: str, default: float | None = None) -> Column:
    """Pearson correlation that yields ``default`` when a side has no variance."""
    both = F.col(left).isNotNull() & F.col(right).isNotNull()
    x, y = F.when(both, F.col(left)), F.when(both, F.col(right))
    result = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return result if default is None else F.coalesce(result, F.lit(default))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division, null for a zero or missing denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def finite(value: Column) -> Column:
    value = value.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def decimal_at_least(value: Column, bound: Column) -> Column:
    """Exact text comparison; null or unparsable is false."""
    return F.coalesce(value.try_cast("decimal(38,18)") >= bound.try_cast("decimal(38,18)"), F.lit(False))


def decimal_at_most(value: Column, bound: Column) -> Column:
    return F.coalesce(value.try_cast("decimal(38,18)") <= bound.try_cast("decimal(38,18)"), F.lit(False))


def governed_difference(left: Column, right: Column, rate: Column) -> Column:
    """Absolute difference for rates, relative to the larger magnitude for levels and flows."""
    gap = F.abs(left - right)
    return F.when(rate, gap).otherwise(gap / F.greatest(F.abs(left), F.abs(right), F.lit(1e-9)))
