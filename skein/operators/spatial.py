"""Spatial search over tables with latitude and longitude columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def search_radius(table: DataFrame, lat: str, lon: str, point: tuple[float, float], radius: float, metric: str = "haversine", strict: bool = False) -> DataFrame:
    return table.filter(geo.within_radius(F.col(lat), F.col(lon), point, radius, metric, strict))


def search_polygon(table: DataFrame, lat: str, lon: str, ring: list[tuple[float, float]]) -> DataFrame:
    return table.filter(geo.in_polygon(F.col(lat), F.col(lon), ring))


def search_box(table: DataFrame, lat: str, lon: str, box: tuple[float, float, float, float]) -> DataFrame:
    """box: least and greatest latitude, least and greatest longitude, all inclusive."""
    return table.filter(geo.in_box(F.col(lat), F.col(lon), box))


def nearest(table: DataFrame, lat: str, lon: str, point: tuple[float, float], k: int, metric: str = "haversine", tie: str = "_rid") -> DataFrame:
    """k nearest rows with their distance; a bounded heap per partition."""
    return table.withColumn("distance", geo.distance(F.col(lat), F.col(lon), point, metric)).orderBy("distance", tie).limit(k)


def by_distance(table: DataFrame, lat: str, lon: str, point: tuple[float, float], metric: str = "haversine", descending: bool = False, tie: str = "_rid") -> DataFrame:
    d = F.col("distance")
    return table.withColumn("distance", geo.distance(F.col(lat), F.col(lon), point, metric)).orderBy(d.desc() if descending else d, tie)
