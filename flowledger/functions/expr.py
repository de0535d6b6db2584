"""Column expressions shared by the operators. NaN and infinities don't occur: divisions give NULL or 0 instead."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def finite(c) -> Column:
    """NaN and infinities as NULL."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def tidy(c, digits: int = 2) -> Column:
    """Rounded, without a negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def ratio(num, den) -> Column:
    """num / den, 0 where the denominator is 0."""
    return F.when(col(den) == 0, F.lit(0.0)).otherwise(col(num) / F.nullif(col(den), F.lit(0.0)))


def try_ratio(num, den) -> Column:
    """num / den, NULL where the denominator is 0."""
    return F.try_divide(col(num), col(den))


def pct_change(start, end, cap: float = 5.0, impute: float = 1.0) -> Column:
    """Change of end against start, capped above; 0 for NULL and for 0 to 0; from 0 it is taken against ``impute``."""
    s, e = col(start), col(end)
    change = F.when(s.isNull() | e.isNull() | ((s == 0) & (e == 0)), 0.0).when(s == 0, e / impute - 1).otherwise(F.try_divide(e, s) - 1)
    return F.least(change, F.lit(float(cap)))


def bucketize(c, thresholds: Mapping[str, float], remainder: str | None) -> Column:
    """Name of the first threshold, in order, that isn't below the value."""
    if remainder is None:
        raise ValueError("a bucket for the remainder is needed")
    out, c = None, col(c)
    for name, t in thresholds.items():
        out = F.when(c <= t, name) if out is None else out.when(c <= t, name)
    return F.when(c.isNull(), None).otherwise(out.otherwise(remainder) if out is not None else F.lit(remainder))


def positive(c) -> Column:
    return F.greatest(col(c), F.lit(0.0))


def negative(c) -> Column:
    return F.greatest(-col(c), F.lit(0.0))


def clip(c, low: float | None = None, high: float | None = None) -> Column:
    c = col(c)
    out = c if low is None else F.greatest(c, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(c.isNull(), None).otherwise(out)


def skewness(c) -> Column:
    """Bias-corrected skewness (G1)."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(c) -> Column:
    """Bias-corrected excess kurtosis (G2)."""
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def weighted_mean(value, weight) -> Column:
    """Sum of value x weight over the sum of weights; NULL if the weights sum to 0."""
    return F.try_divide(F.sum(col(value) * col(weight)), F.sum(col(weight)))


def sum0(c) -> Column:
    """Sum that is 0, not NULL, for no values."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def _fits(c: Column) -> Column:
    return F.abs(c) < 1e9


def _decimals(c: Column) -> Column:
    return F.when(_fits(c), c).cast("decimal(38,18)")


def exact_sum(c) -> Column:
    """Sum that doesn't hang on the order of the rows, taken in decimals of 18 places: amounts of a few digits add up
    exactly, so that a sum can be held against a limit. With a value of 1e9 or more it is the plain sum."""
    c = col(c)
    return F.when(F.bool_and(_fits(c)), F.sum(_decimals(c)).cast("double")).otherwise(F.sum(c))


def exact_mean(c) -> Column:
    """Mean by the same sum: the means of groups that hold the same numbers are equal, whatever the order."""
    c = col(c)
    return F.when(F.bool_and(_fits(c)), F.avg(_decimals(c)).cast("double")).otherwise(F.avg(c))


def names(parts: Sequence[str], sep: str = "|") -> str:
    return sep.join(p for p in parts if p)
