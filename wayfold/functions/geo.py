"""Column functions on points, lines and linear references."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.adapters import ORIGIN_LAT, ORIGIN_LON
from .columns import let

#: Mean radius of the earth in metres.
EARTH_RADIUS = 6371008.8


def lon(x: Column) -> Column:
    return F.lit(ORIGIN_LON) + x / F.lit(1e6)


def lat(y: Column) -> Column:
    return F.lit(ORIGIN_LAT) + y / F.lit(1e6)


def metres(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres between two points in micro-degrees, not rounded."""
    a, b = F.radians(lat(y1)), F.radians(lat(y2))
    half = F.sin((b - a) / 2) * F.sin((b - a) / 2) + F.cos(a) * F.cos(b) * F.sin((F.radians(lon(x2)) - F.radians(lon(x1))) / 2) * F.sin((F.radians(lon(x2)) - F.radians(lon(x1))) / 2)
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(half))


def haversine(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres between two points in micro-degrees, rounded to 2 places."""
    return F.round(metres(x1, y1, x2, y2), 2)


def reach(most: float, y1: Column, y2: Column) -> tuple[Column, Column]:
    """Micro-degrees east and north that `most` metres from a place between the latitudes y1 and y2 can span, rounded up."""
    north = most / (EARTH_RADIUS * math.pi / 180) * 1.001
    widest = F.least(F.lit(89.9), F.greatest(F.abs(lat(y1)), F.abs(lat(y2))) + F.lit(north))
    return F.ceil(F.lit(north * 1e6) / F.cos(F.radians(widest))), F.ceil(F.lit(north * 1e6))


def planar_square(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The square of the metres between two near points in micro-degrees, on a plane: cheap, for filters with some slack."""
    scale = EARTH_RADIUS * math.pi / 180 / 1e6
    east, north = (x2 - x1) * F.lit(scale) * F.cos(F.radians(lat(y1))), (y2 - y1) * F.lit(scale)
    return east * east + north * north


def fraction_along(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where on the edge its nearest point to (px, py) lies, from 0 to 1; planar in degrees; 0 for an edge without length."""
    square = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    dot = (px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / F.nullif(square, F.lit(0)))), F.lit(0.0))


def wkt_point(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), F.format_string("%.6f", lon(x)), F.lit(" "), F.format_string("%.6f", lat(y)), F.lit(")"))


def local(x: Column, y: Column, base: Column) -> tuple[Column, Column]:
    """Metres east and north on the plane that touches the earth at the latitude of base (all in micro-degrees)."""
    scale = EARTH_RADIUS * math.pi / 180 / 1e6
    return x * F.lit(scale) * F.cos(F.radians(lat(base))), y * F.lit(scale)


def projected(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """struct(d2, x, y): the nearest place of an edge to a point, and the square of the distance, on a plane."""
    t = fraction_along(px, py, x1, y1, x2, y2)
    x, y = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
    return F.struct(((px - x) * (px - x) + (py - y) * (py - y)).alias("d2"), x.alias("x"), y.alias("y"))


def edge_gap(a: tuple, b: tuple) -> Column:
    """The square of the distance between two edges (x1, y1, x2, y2) on a plane; 0 where they cross."""
    ends = [projected(*a[:2], *b)["d2"], projected(*a[2:], *b)["d2"], projected(*b[:2], *a)["d2"], projected(*b[2:], *a)["d2"]]
    side = lambda p, q, e: (e[2] - e[0]) * (q - e[1]) - (e[3] - e[1]) * (p - e[0])
    cross = (side(*a[:2], b) * side(*a[2:], b) < 0) & (side(*b[:2], a) * side(*b[2:], a) < 0)
    return F.when(cross, 0.0).otherwise(F.least(*ends))


def nearest_between(a: tuple, b: tuple) -> Column:
    """struct(x, y) on edge a that is nearest to edge b, in the edges' own units: a shared end if there is one, else the best of four projections."""
    from_b = [projected(*b[:2], *a), projected(*b[2:], *a)]  # places on a
    own = [F.struct(projected(*a[i : i + 2], *b)["d2"].alias("d2"), (a[i] * 1.0).alias("x"), (a[i + 1] * 1.0).alias("y")) for i in (0, 2)]
    ranked = F.array(*(F.struct(c["d2"].alias("d2"), F.lit(k).alias("k"), c["x"].alias("x"), c["y"].alias("y")) for k, c in enumerate([*own, *from_b])))
    return F.array_min(ranked)


# The WGS 84 ellipsoid, and scale and false easting of the UTM grid.
_AXIS, _FLATTENING, _SCALE, _EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def transverse_mercator(lon_: Column, lat_: Column, meridian: float = -81.0) -> tuple[Column, Column]:
    """Easting and northing in metres on a northern UTM grid of a central meridian (by default zone 17, EPSG:32617) of degrees.

    Krueger's series to the fourth order of the third flattening: below a millimetre within ten degrees of the meridian.
    """
    n, e = _FLATTENING / (2 - _FLATTENING), math.sqrt(2 * _FLATTENING - _FLATTENING**2)
    radius = _AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    sine, off = F.sin(F.radians(lat_)), F.radians(lon_ - meridian)
    t = F.sinh(F.atanh(sine) - F.lit(e) * F.atanh(F.lit(e) * sine))
    north, east = F.atan2(t, F.cos(off)), F.asinh(F.sin(off) / F.sqrt(t * t + F.cos(off) * F.cos(off)))
    x, y = east, north
    for k, a in enumerate(series, 1):
        x = x + F.lit(a) * F.cos(2 * k * north) * F.sinh(2 * k * east)
        y = y + F.lit(a) * F.sin(2 * k * north) * F.cosh(2 * k * east)
    return _EASTING + _SCALE * radius * x, _SCALE * radius * y


def meets_box(a: tuple, b: tuple, half: float) -> Column:
    """Whether edge b (x1, y1, x2, y2) meets the rectangle that reaches `half` to either side of edge a and ends where a ends; false for an a without length."""
    dx, dy = a[2] - a[0], a[3] - a[1]
    edge = F.struct(dx.alias("dx"), dy.alias("dy"), F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0)).alias("length"))

    def turned(e):
        along = [((b[i] - a[0]) * e["dx"] + (b[i + 1] - a[1]) * e["dy"]) / e["length"] for i in (0, 2)]
        beside = [((b[i + 1] - a[1]) * e["dx"] - (b[i] - a[0]) * e["dy"]) / e["length"] for i in (0, 2)]
        return F.struct(*(c.alias(name) for name, c in zip(("u0", "u1", "v0", "v1"), (*along, *beside), strict=True)), e["length"].alias("length"))

    def share(p: Column, q: Column, low, high) -> tuple[Column, Column]:
        """From where to where on the way from p to q the value lies between low and high."""
        step = q - p
        first, last = (low - p) / F.nullif(step, F.lit(0.0)), (high - p) / F.nullif(step, F.lit(0.0))
        inside = (p >= low) & (p <= high)
        return F.coalesce(F.least(first, last), F.when(inside, 0.0).otherwise(2.0)), F.coalesce(F.greatest(first, last), F.when(inside, 1.0).otherwise(-1.0))

    def meets(c):
        # A micrometre of slack, so that places on the rectangle's sides count whatever the last digits.
        (u0, u1), (v0, v1) = share(c["u0"], c["u1"], F.lit(-1e-6), c["length"] + 1e-6), share(c["v0"], c["v1"], F.lit(-half - 1e-6), F.lit(half + 1e-6))
        return F.coalesce(F.greatest(u0, v0, F.lit(0.0)) <= F.least(u1, v1, F.lit(1.0)), F.lit(False))

    return let(let(edge, turned), meets)
