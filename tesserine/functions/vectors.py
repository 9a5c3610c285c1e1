"""Vectors as arrays of floats, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def fit_dimension(v: Column, size: int) -> Column:
    """Cut or padded with zeros to ``size`` and scaled to length one; a zero vector stays zero."""
    cut = F.slice(F.concat(F.transform(v, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), size)), 1, size)
    length = F.when(norm(cut) == 0, 1.0).otherwise(norm(cut))
    return F.transform(cut, lambda x: x / length)
