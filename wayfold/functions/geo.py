"""Geodesic and planar functions as Column expressions; nothing here runs Python on the executors."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius in metres, and the metres that one degree stands for.
EARTH_RADIUS = 6_371_008.8
METRES_PER_DEGREE = 111_320.0

# Fixed values of the shifted coordinate system: where it holds, and its ellipsoid.
SHIFT_LNG, SHIFT_LAT = (72.004, 137.8347), (0.8293, 55.8271)
SEMI_MAJOR_AXIS, ECCENTRICITY_SQUARED = 6_378_245.0, 0.00669342162296594323
# Polynomial coefficients of (1, x, y, x*x, y*y, x*y, sqrt|x|), and waves (amplitude, divisor of x or y times pi).
SHIFT_LAT_POLY, SHIFT_LNG_POLY = (-100.0, 2.0, 3.0, 0.0, 0.2, 0.1, 0.2), (300.0, 1.0, 2.0, 0.1, 0.0, 0.1, 0.1)
SHIFT_LAT_WAVES = (("x", 20.0, 1 / 6), ("x", 20.0, 1 / 2), ("y", 20.0, 1.0), ("y", 40.0, 3.0), ("y", 160.0, 12.0), ("y", 320.0, 30.0))
SHIFT_LNG_WAVES = (("x", 20.0, 1 / 6), ("x", 20.0, 1 / 2), ("x", 20.0, 1.0), ("x", 40.0, 3.0), ("x", 150.0, 12.0), ("x", 300.0, 30.0))


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return F.when(a.isNotNull(), 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def valid_coordinate(lng: Column, lat: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c)
    return finite(lng) & finite(lat) & lng.between(-180, 180) & lat.between(-90, 90)


def degree_envelope(lng: Column, lat: Column, metres: Column | float) -> dict[str, Column]:
    """Bounds in degrees of a radius in metres; longitude is widened by the cosine of the latitude, 0.01 at least.
    Latitudes beyond the poles, as a derived network may have, widen by their cosine's size too."""
    dy = F.lit(metres) / METRES_PER_DEGREE
    dx = dy / F.greatest(F.lit(0.01), F.abs(F.cos(F.radians(lat))))
    return {"min_lng": lng - dx, "max_lng": lng + dx, "min_lat": lat - dy, "max_lat": lat + dy}


def segment_fraction(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Clamped place in [0, 1] of a point's projection on a segment, in the plane; 0 on a segment without length."""
    square = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.nullif(square, F.lit(0.0))
    return F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def point_segment_metres(lng: Column, lat: Column, alng: Column, alat: Column, blng: Column, blat: Column) -> Column:
    """Metres from a point to a segment in an equirectangular plane around the point."""
    k = F.radians(F.lit(1.0)) * EARTH_RADIUS
    x = lambda c: (c - lng) * k * F.cos(F.radians(lat))
    y = lambda c: (c - lat) * k
    zero = F.lit(0.0)
    t = segment_fraction(zero, zero, x(alng), y(alat), x(blng), y(blat))
    return F.hypot(x(alng) + t * (x(blng) - x(alng)), y(alat) + t * (y(blat) - y(alat)))


def interpolate(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def rounded(c: Column, digits: int) -> Column:
    """round(c, digits) of doubles, by arithmetic: as many places of a decimal as `digits`, halves away from zero. Values that are
    large, or too near a half for arithmetic to tell, take round() itself, which goes by decimal text and is some ten times slower."""
    scale = 10.0**digits
    at = F.abs(c) * scale
    low = F.floor(at)
    plain = (at < 1e10) & (F.abs(at - low - 0.5) > 1e-4)
    near = F.floor(at + 0.5) / scale
    return F.when(plain, F.when(c < 0, F.lit(0.0) - near).otherwise(near)).otherwise(F.round(c, digits))


def bearing(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    d = F.radians(lng2 - lng1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def bearing_delta(a: Column, b: Column) -> Column:
    """Smallest difference of two bearings, in [0, 180]."""
    d = F.abs(a - b) % 360
    return F.least(d, 360 - d)


def _shift(lng: Column, lat: Column) -> tuple[Column, Column]:
    x, y = lng - 105.0, lat - 35.0
    axis = {"x": x, "y": y}

    def series(poly: tuple[float, ...], waves: tuple[tuple[str, float, float], ...]) -> Column:
        terms = (F.lit(1.0), x, y, x * x, y * y, x * y, F.sqrt(F.abs(x)))
        flat = reduce(lambda a, b: a + b, (t * c for t, c in zip(terms, poly, strict=True) if c))
        return flat + reduce(lambda a, b: a + b, (F.sin(axis[v] * (math.pi / d)) * (a * 2.0 / 3.0) for v, a, d in waves))

    magic = 1 - ECCENTRICITY_SQUARED * F.pow(F.sin(F.radians(lat)), 2)
    metres_lat = SEMI_MAJOR_AXIS * (1 - ECCENTRICITY_SQUARED) / F.pow(magic, 1.5)
    metres_lng = SEMI_MAJOR_AXIS / F.sqrt(magic) * F.cos(F.radians(lat))
    return F.degrees(series(SHIFT_LNG_POLY, SHIFT_LNG_WAVES) / metres_lng), F.degrees(series(SHIFT_LAT_POLY, SHIFT_LAT_WAVES) / metres_lat)


def _shifted_here(lng: Column, lat: Column) -> Column:
    return lng.between(*SHIFT_LNG) & lat.between(*SHIFT_LAT)


def to_gcj02(lng: Column, lat: Column) -> Column:
    """struct<lng, lat> in the shifted system; the same coordinates where it doesn't hold."""
    dx, dy = _shift(lng, lat)
    here = _shifted_here(lng, lat)
    return F.struct(F.when(here, lng + dx).otherwise(lng).alias("lng"), F.when(here, lat + dy).otherwise(lat).alias("lat"))


def to_wgs84(lng: Column, lat: Column, rounds: int = 30, enough: float = 1e-8) -> Column:
    """struct<lng, lat> that to_gcj02() takes to the given place: a fixed point, left alone once its error is `enough`."""
    start = F.struct(lng.alias("lng"), lat.alias("lat"), F.lit(False).alias("done"))

    def step(state: Column, _: Column) -> Column:
        there = to_gcj02(state["lng"], state["lat"])
        ex, ey = there["lng"] - lng, there["lat"] - lat
        return F.when(state["done"], state).otherwise(F.struct((state["lng"] - ex).alias("lng"), (state["lat"] - ey).alias("lat"), (F.greatest(F.abs(ex), F.abs(ey)) <= enough).alias("done")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    here = _shifted_here(lng, lat)
    return F.when(here, F.struct(found["lng"].alias("lng"), found["lat"].alias("lat"))).otherwise(F.struct(lng.alias("lng"), lat.alias("lat")))


def to_wgs84_once(lng: Column, lat: Column) -> Column:
    """The one-step inverse 2p - f(p), less exact than to_wgs84()."""
    there = to_gcj02(lng, lat)
    return F.struct((2 * lng - there["lng"]).alias("lng"), (2 * lat - there["lat"]).alias("lat"))


def polyline_metres(points: Column) -> Column:
    """Length of array<struct<lng, lat>>; 0 for fewer than two points."""
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: haversine(a["lng"], a["lat"], b["lng"], b["lat"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def poi_radius(clearance: Column, highway: Column) -> Column:
    """Search radius around a hand-off point: 0 on a highway, else the clearance less 25 m, within 0 and 200."""
    return F.when(highway, 0).otherwise(F.floor(F.least(F.lit(200.0), F.greatest(F.lit(0.0), clearance - 25))).cast("int"))


def change_ratio(now: Column, before: Column) -> Column:
    """|now - before| / before; over a zero, 0 if both are zero, else 1."""
    return F.when(before == 0, F.when(now == 0, 0.0).otherwise(1.0)).otherwise(F.try_divide(F.abs(now - before), before))


def saturated_add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a, b), F.lit((1 << 63) - 1))
