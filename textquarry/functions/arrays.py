"""Arrays as insertion-ordered sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Joins array elements where a result must compare as text.
MARK = "\u0001"


def empty() -> Column:
    return F.array().cast("array<string>")


def ordered_set(*arrays: Column) -> Column:
    """The elements of all arrays in order, each once; null arrays are empty."""
    return F.array_distinct(F.concat(*[F.coalesce(a, empty()) for a in arrays]))


def as_text(array: Column) -> Column:
    """The elements as one text; null for null."""
    return F.array_join(array, MARK)
