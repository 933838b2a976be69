"""Rounding, percentile and vector columns. The four percentile definitions are different on purpose; none may replace another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_percentile(values: Column, p: float) -> Column:
    """Of sorted values, the one at place min(n - 1, int(p (n - 1) + 0.5)), rounded to one digit."""
    n = F.size(values)
    return F.round(F.element_at(values, F.least(n - 1, (p * (n - 1) + 0.5).cast("int")) + 1), 1)


def floor_percentile(values: Column, p: float) -> Column:
    """The value at place int(p (n - 1))."""
    return F.element_at(values, F.floor(p * (F.size(values) - 1)).cast("int") + 1)


def upper_median(values: Column) -> Column:
    """The value at place n // 2."""
    return F.element_at(values, F.floor(F.size(values) / 2).cast("int") + 1)


def middle_median(values: Column) -> Column:
    """The mean of the one or two values in the middle; null if there are none."""
    n = F.size(values)
    low = F.element_at(values, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(values, F.floor(n / 2).cast("int") + 1)
    return F.when(n > 0, (low + high) / 2)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    """One list's part of a fused score, for a rank that starts at 0; null where the list lacks the row."""
    return F.coalesce(F.lit(1.0) / (rank + k + 1), F.lit(0.0))
