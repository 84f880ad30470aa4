"""Distances and similarities as Spark column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
METRICS = ("euclidean", "cosine", "dot")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres, in the half-angle form that is exact for near points."""
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    h = F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def planar(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in coordinate units; the antimeridian is not wrapped."""
    return F.hypot(lon2 - lon1, lat2 - lat1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def vector_literal(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def dot_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def euclidean_distance(a: Column, b: Column) -> Column:
    def square(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.sqrt(_sum(F.zip_with(a, b, square)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a norm is 0; clamped to [-1, 1]."""
    norms = F.sqrt(dot_product(a, a)) * F.sqrt(dot_product(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot_product(a, b) / norms)))


def vector_distance(a: Column, b: Column, metric: str) -> Column:
    """On a scale where smaller is nearer for every metric."""
    if metric == "euclidean":
        return euclidean_distance(a, b)
    if metric == "cosine":
        return 1 - cosine_similarity(a, b)
    if metric == "dot":
        return -dot_product(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def from_distance(distance: Column, metric: str) -> Column:
    """The metric's own score: distance, similarity or product."""
    return {"euclidean": distance, "cosine": 1 - distance, "dot": -distance}[metric]


def higher_is_better(metric: str) -> bool:
    return metric != "euclidean"
