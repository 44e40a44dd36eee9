"""Transverse Mercator as column expressions, by the series of Snyder (1987) on the GRS80 ellipsoid."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: GRS80, and the published parameters of EPSG:3116.
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
LAT0, LON0, SCALE, EAST0, NORTH0 = 4.596200416666666, -74.07750791666666, 1.0, 1_000_000.0, 1_000_000.0

_E2 = FLATTENING * (2 - FLATTENING)
_EP2 = _E2 / (1 - _E2)
#: Coefficients of the meridian arc over the angle and the sines of its even multiples.
_ARC = (
    1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256,
    -(3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024),
    15 * _E2**2 / 256 + 45 * _E2**3 / 1024,
    -35 * _E2**3 / 3072,
)


def _arc(phi: Column) -> Column:
    return AXIS * (_ARC[0] * phi + _ARC[1] * F.sin(2 * phi) + _ARC[2] * F.sin(4 * phi) + _ARC[3] * F.sin(6 * phi))


def to_plane(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(east, north) in metres of a longitude and latitude in degrees."""
    phi, p0 = F.radians(lat), math.radians(LAT0)
    arc0 = AXIS * (_ARC[0] * p0 + sum(c * math.sin(2 * (i + 1) * p0) for i, c in enumerate(_ARC[1:])))
    t, c = F.tan(phi) ** 2, _EP2 * F.cos(phi) ** 2
    a = F.radians(lon - LON0) * F.cos(phi)
    n = AXIS / F.sqrt(1 - _E2 * F.sin(phi) ** 2)
    east = SCALE * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * _EP2) * a**5 / 120) + EAST0
    rise = a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * _EP2) * a**6 / 720
    return east, SCALE * (_arc(phi) - arc0 + n * F.tan(phi) * rise) + NORTH0


def _in_metres(p: Column) -> Column:
    east, north = to_plane(p["x"], p["y"])
    return F.struct(east.alias("x"), north.alias("y"))


def project_points(points: Column) -> Column:
    """Points in degrees as points in metres."""
    return F.transform(points, _in_metres)


def project_rings(rings: Column) -> Column:
    """Rings in degrees as rings in metres."""
    return F.transform(rings, lambda r: F.struct(r["hole"].alias("hole"), F.transform(r["points"], _in_metres).alias("points")))
