"""Geometry on longitudes and latitudes in degrees, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES = 6371000.0
KILOMETRES = 6367.0


def spherical_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = METRES) -> Column:
    """Great-circle distance by half angles, in the unit of ``radius``."""
    dlon, dlat = F.radians(lon1 - lon2) / 2, F.radians(lat1 - lat2) / 2
    mid = F.radians(lat1 + lat2) / 2
    square = F.pow(F.sin(dlat) * F.cos(dlon), F.lit(2)) + F.pow(F.sin(dlon) * F.cos(mid), F.lit(2))
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(square)))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = KILOMETRES) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, F.lit(2)) + F.pow(y1 - y2, F.lit(2)))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Compass bearing from the first point to the second, 0 to 360."""
    d = F.radians(lon2 - lon1)
    a, b = F.radians(lat1), F.radians(lat2)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.when(angle < 0, angle + 360).otherwise(angle)


def metres_to_degrees(metres: Column, radius: float = METRES) -> Column:
    return F.degrees(metres / radius)


def segment_fraction(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Where on segment a-b the point closest to p lies, 0 to 1; null for a segment of one point."""
    dx, dy = bx - ax, by - ay
    u = ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)
    return F.when((dx != 0) | (dy != 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), u)))


def closest_on_segment(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """struct(x, y) of the point of a-b closest to p; p itself for a segment of one point."""
    u = segment_fraction(ax, ay, bx, by, px, py)
    return F.struct(F.coalesce(ax + u * (bx - ax), px).alias("x"), F.coalesce(ay + u * (by - ay), py).alias("y"))


def point_at(ax: Column, ay: Column, at: Column, bx: Column, by: Column, bt: Column, after: Column) -> Column:
    """struct(x, y, t): the point ``after`` seconds behind a on the way to b; b when that is past it or the way is vertical."""
    share = after / (bt - at)
    past = (after >= bt - at) | (ax == bx)
    return F.struct(F.when(past, bx).otherwise(ax + share * (bx - ax)).alias("x"), F.when(past, by).otherwise(ay + share * (by - ay)).alias("y"), F.when(past, bt).otherwise(at + after).alias("t"))


def rectangle_area(bottom: Column, left: Column, top: Column, right: Column) -> Column:
    return (top - bottom) * (right - left)


def region_of(lon: Column, lat: Column, regions: list[tuple[str, float, float, float, float]]) -> Column:
    """Name of the first of a few rectangles (name, bottom, left, top, right) that holds the point, borders included; null if none."""
    found = F.lit(None).cast("string")
    for name, bottom, left, top, right in reversed(regions):
        found = F.when(lat.between(bottom, top) & lon.between(left, right), name).otherwise(found)
    return found


def sql_distance(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = METRES) -> str:
    """The spherical distance in SQL, for checks."""
    return (
        f"(2 * {radius} * asin(least(1.0, sqrt(pow(sin(radians({lat1} - {lat2}) / 2) * cos(radians({lon1} - {lon2}) / 2), 2) "
        f"+ pow(sin(radians({lon1} - {lon2}) / 2) * cos(radians({lat1} + {lat2}) / 2), 2)))))"
    )
