"""Column functions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0; null for a null array or different lengths."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n > 0, dot(a, b) / n).otherwise(0.0))


def usable(a: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` elements, none null, not all zero; false for null."""
    return F.coalesce((F.size(a) == dim) & F.forall(a, lambda e: e.isNotNull()) & F.exists(a, lambda e: e != 0), F.lit(False))
