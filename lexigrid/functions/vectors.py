"""Similarities of vectors, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def score(a: Column, b: Column, distance: str) -> Column:
    """Higher is nearer, for all distances."""
    kinds = {"cosine": cosine, "dot": dot, "euclid": lambda x, y: -euclid(x, y)}
    if distance.lower() not in kinds:
        raise ValueError(f"distance must be one of {', '.join(kinds)}")
    return kinds[distance.lower()](a, b)
