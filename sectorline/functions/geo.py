"""Geometry on latitude and longitude as Column expressions. Points and lines are given by their columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Miles per degree of arc, and units of a mile.
MILES_PER_DEGREE = 60 * 1.1515
UNITS = {"K": 1.609344, "N": 0.8684}


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "K") -> Column:
    """Spherical law of cosines; any unit but K and N gives miles."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon1 - lon2)
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))) * MILES_PER_DEGREE * UNITS.get(unit, 1.0)


def length_meters(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return distance(lat1, lon1, lat2, lon2) * 1000


def midpoint(x1: Column, x2: Column) -> Column:
    return (x1 + x2) / 2


def within_box(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat: Column, lon: Column) -> Column:
    """Inclusive on all edges, whatever corners are given."""
    inside = lambda p, a, b: p.between(F.least(a, b), F.greatest(a, b))
    return inside(lat, lat1, lat2) & inside(lon, lon1, lon2)


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def center_factor(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat: Column, lon: Column) -> Column:
    """1 at equal distance to both ends, 0 at an end."""
    a, b = distance(lat1, lon1, lat, lon), distance(lat2, lon2, lat, lon)
    return F.when(a + b <= 0, 0.0).otherwise(_clamped(1 - F.try_divide(F.abs(a - b), a + b)))


def projection_factor(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat: Column, lon: Column) -> Column:
    """Place of a point's planar projection on a line, within [0, 1]; 0 on a line without length."""
    dx, dy = lat2 - lat1, lon2 - lon1
    return F.coalesce(_clamped(F.try_divide((lat - lat1) * dx + (lon - lon1) * dy, dx * dx + dy * dy)), F.lit(0.0))


def signed_area(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat: Column, lon: Column) -> Column:
    return (lat2 - lat1) * (lon - lon1) - (lon2 - lon1) * (lat - lat1)


def intersection(line: tuple, other: tuple, direction: str = "any") -> Column:
    """struct<lat, lon> where two closed segments meet, else null; parallels never meet.

    direction: 'any', 'toward' (rejects a negative denominator) or 'away' (rejects a positive one).
    """
    (a1, o1, a2, o2), (a3, o3, a4, o4) = line, other
    dx, dy, ex, ey = a2 - a1, o2 - o1, a4 - a3, o4 - o3
    den = dy * ex - dx * ey
    t = F.try_divide((a1 - a3) * ey + (o3 - o1) * ex, den)
    u = F.try_divide((a3 - a1) * dy + (o1 - o3) * dx, -den)
    allowed = {"any": F.lit(True), "toward": den >= 0, "away": den <= 0}[direction]
    hit = t.between(0, 1) & u.between(0, 1) & allowed
    return F.when(hit, F.struct((a1 + (a2 - a1) * t).alias("lat"), (o1 + (o2 - o1) * t).alias("lon")))
