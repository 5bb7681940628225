"""Places on the earth, given as longitude and latitude in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the earth's mean radius in metres.
RADIUS = 6371008.8


def haversine(lon: Column, lat: Column, to_lon: float, to_lat: float) -> Column:
    """Metres between two places."""
    a, b = F.radians(lat), F.radians(F.lit(to_lat))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(F.lit(to_lon)) - F.radians(lon)) / 2), 2)
    return F.lit(2 * RADIUS) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def in_box(lon: Column, lat: Column, box: dict) -> Column:
    """Strictly inside; a box whose left is greater than its right crosses the date line."""
    left, right = box["top_left"]["lon"], box["bottom_right"]["lon"]
    across = (lon > left) | (lon < right) if left > right else (lon > left) & (lon < right)
    return across & (lat < box["top_left"]["lat"]) & (lat > box["bottom_right"]["lat"])


def _ring(lon: Column, lat: Column, points: list[dict]) -> tuple[Column, Column]:
    """Whether a place is inside a closed ring (a ray crosses it an odd number of times), and whether on its line."""
    if len(points) < 4 or points[0] != points[-1]:
        raise ValueError("a ring has four points at least, the last like the first")
    crossings, border = F.lit(0), F.lit(False)
    for a, b in zip(points, points[1:]):
        (x1, y1), (x2, y2) = (float(a["lon"]), float(a["lat"])), (float(b["lon"]), float(b["lat"]))
        if y1 != y2:
            meets = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1)
            crossings = crossings + meets.cast("int")
        on = (lon - x1) * (y2 - y1) == (lat - y1) * (x2 - x1)
        border = border | on & lon.between(min(x1, x2), max(x1, x2)) & lat.between(min(y1, y2), max(y1, y2))
    return crossings % 2 == 1, border


def in_polygon(lon: Column, lat: Column, polygon: dict) -> Column:
    """Inside the exterior and in none of the interiors; not on a line."""
    inside, border = _ring(lon, lat, polygon["exterior"]["points"])
    result = inside & ~border
    for ring in polygon.get("interiors") or []:
        hole, edge = _ring(lon, lat, ring["points"])
        result = result & ~hole & ~edge
    return result
