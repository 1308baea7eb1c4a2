"""Arithmetic on measures.  A missing result is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

USD_PER_KUSD = 1000
MILLION = 1e6
BILLION = 1e9


def total_of(summed: Column) -> Column:
    """A sum as double; a group of missing values sums to 0."""
    return F.coalesce(summed.cast("double"), F.lit(0.0))


def total(c: str | Column) -> Column:
    return total_of(F.sum(c))


def total_if(condition: Column, c: str) -> Column:
    return total(F.when(condition, F.col(c)))


def unit_value(v: Column, q: Column) -> Column:
    """Value per ton where a positive quantity is known, else NULL."""
    return F.when(q > 0, v.cast("double") / q)


def smoothed_unit_value(value: Column, quantity: Column) -> Column:
    """Value per ton of a group whose quantity may be zero."""
    return value / (quantity + F.lit(0.001))


def clamped_log(x: Column) -> Column:
    """``log(1 + x)`` with negative input taken as zero; NULL stays NULL."""
    return F.log1p(F.when(x < 0, F.lit(0.0)).otherwise(x.cast("double")))


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where the whole is not positive."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def coverage_pct(exports: Column, imports: Column) -> Column:
    return F.try_divide(exports, imports) * 100


def change_pct(current: Column, previous: Column) -> Column:
    return (F.try_divide(current, previous) - 1) * 100


def span(first: Column, last: Column) -> Column:
    """Number of periods from first to last, both included."""
    return last - first + 1


def usd(kusd: Column) -> Column:
    return kusd * USD_PER_KUSD


def even_round(c: Column, places: int = 2) -> Column:
    """Round half to even."""
    return F.bround(c, places)


def no_nan(c: Column) -> Column:
    """NaN as NULL, so that documents and aggregates see a missing value."""
    return F.when(~F.isnan(c), c)


def jarque_bera(n: Column, skewness: Column, kurtosis: Column) -> Column:
    """Normality statistic from population skewness and excess kurtosis."""
    return n / 6 * (skewness * skewness + kurtosis * kurtosis / 4)
