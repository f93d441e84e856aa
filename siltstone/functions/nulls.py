"""One missing value: NaN becomes NULL at every scan, and these spell what differs from SQL's NULL rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def without_nan(df: DataFrame) -> DataFrame:
    """All floating columns with NaN as NULL, in one projection."""
    return df.select(*(nan_to_null(F.col(f"`{n}`")).alias(n) if t in ("float", "double") else F.col(f"`{n}`") for n, t in df.dtypes))


def zsum(c: Column) -> Column:
    """Sum that is 0.0 where a group has no value."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.nullif(b, F.lit(0))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clamp that keeps NULL (greatest and least would skip it)."""
    out = F.when(c < low, F.lit(low)) if low is not None else None
    if high is not None:
        out = F.when(c > high, F.lit(high)) if out is None else out.when(c > high, F.lit(high))
    return c if out is None else out.otherwise(c)


def flag(condition: Column) -> Column:
    """1 where true, else 0 (also where NULL)."""
    return F.when(condition, 1).otherwise(0)


def finite_or_zero(c: Column) -> Column:
    """Feature value: missing and infinite become 0, as float."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0))).cast("float")
