"""Vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length; null if one is all zero or null."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def usable(v: Column, width: int) -> Column:
    """Not null, of the given width and not all zero."""
    return F.coalesce((F.size(v) == width) & F.exists(v, lambda x: x != 0), F.lit(False))
