"""Vector rules on arrays of floats, summed as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; 0 if a norm is 0 or the lengths differ; null if a vector is null."""
    size = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def l2_normalized(a: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: (x / size).cast("float"))).otherwise(a)
