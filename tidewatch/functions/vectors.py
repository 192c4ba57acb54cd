"""Feature vectors: text elements to doubles, fitting to a fixed length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_doubles(elements: Column) -> Column:
    """Array of text (or numbers) to array of doubles; null as soon as one element is no number.

    A missing vector counts as an empty one.
    """
    numbers = F.coalesce(elements.try_cast("array<double>"), F.array().cast("array<double>"))
    # Wrapped in an array so that the cast is evaluated once for both the test and the result.
    return F.get(F.filter(F.array(numbers), lambda v: ~F.exists(v, lambda x: x.isNull())), F.lit(0))


def fit(vector: Column, size: int) -> Column:
    """Cut or zero-pad to ``size`` elements."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), size)), 1, size)
