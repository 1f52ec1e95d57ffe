"""Vector measures as column expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "inner_product")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if the lengths differ."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine; 0 for vectors of different lengths, empty ones and those of length zero."""
    length = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 0)
    return F.when(F.coalesce(usable, F.lit(False)), F.try_divide(dot(a, b), length)).otherwise(0.0)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Higher is nearer: cosine, 1 / (1 + L2 distance), or the inner product."""
    if metric not in METRICS:
        metric = "cosine"
    if metric == "cosine":
        return cosine_similarity(a, b)
    usable = F.coalesce((F.size(a) == F.size(b)) & (F.size(a) > 0), F.lit(False))
    return F.when(usable, 1 / (1 + l2_distance(a, b)) if metric == "l2" else dot(a, b)).otherwise(0.0)


def distance_to_similarity(distance: Column, metric: str = "cosine") -> Column:
    """A stored distance as a similarity: 1 - d, 1 / (1 + d), or -d for negated inner products."""
    return {"cosine": 1 - distance, "l2": 1 / (1 + distance), "inner_product": -distance}[metric]


def vector_literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))
