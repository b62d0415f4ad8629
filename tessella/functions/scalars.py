"""Scalar column functions with defined behaviour at the edges of their domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    """False for null, NaN and infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def ihs(x: Column) -> Column:
    """Inverse hyperbolic sine, accurate for large negative and for tiny values."""
    return F.when(F.abs(x) < 1e-4, x - x * x * x / 6).otherwise(F.signum(x) * F.asinh(F.abs(x)))


def clip(x: Column, lo: float | Column | None, hi: float | Column | None) -> Column:
    """x within [lo, hi]; null and NaN stay as they are."""
    out = x
    if lo is not None:
        out = F.when(out < lo, lo).otherwise(out)
    if hi is not None:
        out = F.when(~F.isnan(x) & (out > hi), hi).otherwise(out)
    return F.when(x.isNotNull(), out)


def checked(x: Column, ok: Column, message: str) -> Column:
    """x, or an error where ok is false; null passes."""
    return F.when(F.coalesce(ok, F.lit(True)), x).otherwise(F.raise_error(F.lit(message)).cast("double"))


def average_rank(x: Column, window) -> Column:
    """Rank with ties averaged; window is partitioned as wanted and unordered."""
    return F.rank().over(window.orderBy(x)) + (F.count(F.lit(1)).over(window.partitionBy(x)) - 1) / 2
