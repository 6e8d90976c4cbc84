"""Vector expressions: arrays of doubles, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column, least: float = 1e-12) -> Column:
    """Unit rows; a zero vector stays zero."""
    length = F.greatest(norm(v), F.lit(least))
    return F.transform(v, lambda x: x / length)


def strict_normalize(v: Column) -> Column:
    """Unit rows; a zero vector gives nulls."""
    return F.transform(v, lambda x: F.try_divide(x, norm(v)))


def cosine_distance(a: Column, b: Column) -> Column:
    """Of unit vectors."""
    return F.lit(1.0) - dot(a, b)


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean of the values whose mask is 1; 0 where none is."""
    total = F.aggregate(F.zip_with(values, mask, lambda x, m: x * m), F.lit(0.0), lambda s, x: s + x)
    return total / F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1.0))


def gpd_survival(x: Column, shape: Column, scale: Column) -> Column:
    """Of a generalised Pareto excess; exponential at shape 0, 0 beyond the end point of a negative shape."""
    inner = F.lit(1.0) + shape * x / scale
    return F.when(F.abs(shape) < 1e-12, F.exp(-x / scale)).when(inner <= 0, 0.0).otherwise(F.pow(inner, F.lit(-1.0) / F.when(F.abs(shape) < 1e-12, F.lit(1.0)).otherwise(shape)))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, and never -0."""
    return F.round(c, digits) + F.lit(0.0)
