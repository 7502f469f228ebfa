"""Vector columns (arrays of numbers)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x / length)).otherwise(a)


def squared_distance(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def cosine_from(dot_ab: Column, norm_a: Column, norm_b: Column) -> Column:
    return F.coalesce(F.try_divide(dot_ab, norm_a * norm_b), F.lit(0.0))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine; 0 when either vector has no length."""
    return cosine_from(dot(a, b), norm(a), norm(b))
