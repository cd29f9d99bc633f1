"""Vector column functions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """The vector at length one; an all-zero vector stays."""
    n = norm(a)
    return F.transform(a.cast("array<double>"), lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
