"""Distances, projections and grid cells as column expressions.

Two coordinate systems share column names in this domain, so every function
that measures takes the system explicitly: ``wgs84`` (degrees, great circle) or
``projected_xy`` (metres, straight line).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_000.0
PLANNER_KM_PER_DEGREE = 111.32
CRS = ("wgs84", "projected_xy")


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else (value if isinstance(value, Column) else F.lit(value))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def distances_m(lat1, lon1, lat2, lon2) -> np.ndarray:
    """``haversine_m`` of every point of one list from every point of another, inside a task."""
    (lat1, lon1), (lat2, lon2) = ([np.radians(np.asarray(c, dtype=np.float64)) for c in pair] for pair in ((lat1, lon1), (lat2, lon2)))
    half_lat, half_lon = (np.sin((two - one[:, None]) / 2) for one, two in ((lat1, lat2), (lon1, lon2)))
    a = half_lat * half_lat + np.cos(lat1)[:, None] * np.cos(lat2) * half_lon * half_lon
    return 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(1.0 - a))


def euclidean_m(x1, y1, x2, y2) -> Column:
    dx, dy = _c(x2) - _c(x1), _c(y2) - _c(y1)
    return F.sqrt(dx * dx + dy * dy)


def distance_m(crs: str, a1, a2, b1, b2) -> Column:
    """Distance between (a1, a2) and (b1, b2); the pair is (lat, lon) or (x, y) by ``crs``."""
    if crs == "wgs84":
        return haversine_m(a1, a2, b1, b2)
    if crs == "projected_xy":
        return euclidean_m(a1, a2, b1, b2)
    raise ValueError(f"unknown coordinate system {crs!r}; expected one of {CRS}")


def planner_distance_km(origin_lat, origin_lon, lat, lon) -> Column:
    """Flat-earth kilometres around an origin, as the visit planner measures them."""
    d_lat = (_c(lat) - _c(origin_lat)) * PLANNER_KM_PER_DEGREE
    d_lon = (_c(lon) - _c(origin_lon)) * PLANNER_KM_PER_DEGREE * F.cos(F.radians(_c(origin_lat)))
    return F.sqrt(d_lat * d_lat + d_lon * d_lon)


def local_metres(lat, lon, mean_lat, mean_lon) -> tuple[Column, Column]:
    """(north, east) metres relative to a mean point."""
    north = (_c(lat) - _c(mean_lat)) * METRES_PER_DEGREE
    east = (_c(lon) - _c(mean_lon)) * METRES_PER_DEGREE * F.cos(F.radians(_c(mean_lat)))
    return north, east


def coordinate_key(a, b) -> Column:
    """Six-decimal text key of a coordinate pair."""
    return F.format_string("%.6f,%.6f", _c(a).cast("double"), _c(b).cast("double"))


def box_degrees(radius_m: float) -> float:
    return radius_m / METRES_PER_DEGREE


def in_box(a, b, centre_a, centre_b, half: float) -> Column:
    """|a - centre_a| <= half and |b - centre_b| <= half, as two range tests."""
    a, b, ca, cb = map(_c, (a, b, centre_a, centre_b))
    return a.between(ca - F.lit(half), ca + F.lit(half)) & b.between(cb - F.lit(half), cb + F.lit(half))


def cell(value, size: float) -> Column:
    return F.floor(_c(value) / F.lit(size)).cast("long")


def offsets(reach: int, inner: int = -1) -> Column:
    """Array literal of (dx, dy) with max-norm in (inner, reach]."""
    pairs = [
        (dx, dy)
        for dx in range(-reach, reach + 1)
        for dy in range(-reach, reach + 1)
        if max(abs(dx), abs(dy)) > inner
    ]
    return F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx, dy in pairs])
