"""Vector arithmetic as column expressions, in doubles; no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 where either is empty, null or of another length."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), _sum(products)).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.coalesce(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))), F.lit(0.0)))


def normalize(a: Column) -> Column:
    """Of length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Divided by both norms, not clamped; 0 if either is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def cosine_clamped(a: Column, b: Column) -> Column:
    """Held to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b)))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def subtract(a: Column, b: Column) -> Column:
    """Element by element; what is missing counts as 0."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)).cast("double") - F.coalesce(y, F.lit(0)).cast("double"))
