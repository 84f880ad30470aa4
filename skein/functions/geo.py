"""Geometry of points (latitude, longitude): radius boxes and polygons with the border inside."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metrics import EARTH_RADIUS_M, haversine, planar

TOLERANCE = 1e-12
SPATIAL_METRICS = ("haversine", "euclidean")


def distance(lat: Column, lon: Column, point: tuple[float, float], metric: str = "haversine") -> Column:
    f = haversine if metric == "haversine" else planar
    return f(lat, lon, F.lit(float(point[0])), F.lit(float(point[1])))


def radius_box(point: tuple[float, float], radius: float, metric: str = "haversine") -> tuple[float, float, float, float]:
    """(least latitude, greatest latitude, least longitude, greatest longitude) that hold every point within radius.

    All longitudes where the circle reaches a pole or the antimeridian. A little wider than the circle.
    """
    lat, lon = point
    if metric == "euclidean":
        d = radius * (1 + TOLERANCE) + TOLERANCE
        return lat - d, lat + d, lon - d, lon + d
    angle = radius / EARTH_RADIUS_M * (1 + TOLERANCE) + TOLERANCE
    low, high = lat - math.degrees(angle), lat + math.degrees(angle)
    if low <= -90 or high >= 90 or angle >= math.pi / 2:
        return max(low, -90.0), min(high, 90.0), -180.0, 180.0
    spread = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat))))) * (1 + TOLERANCE) + TOLERANCE
    if lon - spread < -180 or lon + spread > 180:
        return low, high, -180.0, 180.0
    return low, high, lon - spread, lon + spread


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Plain comparisons, which Parquet readers use to skip files and row groups."""
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def within_radius(lat: Column, lon: Column, point: tuple[float, float], radius: float, metric: str = "haversine", strict: bool = False) -> Column:
    d = distance(lat, lon, point, metric)
    return in_box(lat, lon, radius_box(point, radius, metric)) & ((d < radius) if strict else (d <= radius))


def polygon_box(ring: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    lats, lons = [p[0] for p in ring], [p[1] for p in ring]
    slack = max(1.0, *map(abs, lats + lons)) * TOLERANCE
    return min(lats) - slack, max(lats) + slack, min(lons) - slack, max(lons) + slack


def in_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the ring's edges; points on an edge or vertex are inside. Self-contained arithmetic
    over literals, behind the bounding box."""
    if len(set(ring)) < 3:
        raise ValueError("a polygon needs three distinct vertices")
    scale = F.greatest(F.lit(max(1.0, *(abs(c) for p in ring for c in p))), F.abs(lat), F.abs(lon))
    crossings, border = F.lit(0), F.lit(False)
    for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        cross = (lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1)
        slack = scale * TOLERANCE
        inside = (lon >= F.lit(min(x1, x2)) - slack) & (lon <= F.lit(max(x1, x2)) + slack) & (lat >= F.lit(min(y1, y2)) - slack) & (lat <= F.lit(max(y1, y2)) + slack)
        border = border | ((F.abs(cross) <= scale * scale * TOLERANCE) & inside)
        if y1 != y2:
            straddles = (F.lit(y1) > lat) != (F.lit(y2) > lat)
            at = F.lit((x2 - x1) / (y2 - y1)) * (lat - y1) + x1
            crossings = crossings + F.when(straddles & (lon < at), 1).otherwise(0)
    return in_box(lat, lon, polygon_box(ring)) & (border | (crossings % 2 == 1))
