"""Functions over polylines, array<struct<lng, lat>>, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions import geo


def _let(value: Column, use) -> Column:
    """use(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pairs(points: Column, of) -> Column:
    """of(point, next point) for each step; empty below two points."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), of)


def cumulative_metres(points: Column) -> Column:
    """Metres from the start to each point; [0] for one point."""
    steps = _pairs(points, lambda a, b: geo.haversine(a["lng"], a["lat"], b["lng"], b["lat"]))
    return F.aggregate(steps, F.array(F.lit(0.0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))


def point_at(points: Column, metres: Column) -> Column:
    """The place `metres` along the line, within its ends."""

    def place(cum: Column) -> Column:
        at = F.greatest(F.lit(0.0), F.least(metres, F.element_at(cum, -1)))
        i = F.least(F.size(F.filter(cum, lambda c: c <= at)), F.size(points) - 1)
        a, b = F.element_at(points, i), F.element_at(points, i + 1)
        t = F.coalesce((at - F.element_at(cum, i)) / F.nullif(F.element_at(cum, i + 1) - F.element_at(cum, i), F.lit(0.0)), F.lit(0.0))
        return F.struct(geo.interpolate(a["lng"], b["lng"], t).alias("lng"), geo.interpolate(a["lat"], b["lat"], t).alias("lat"))

    return F.when(F.size(points) == 1, F.element_at(points, 1)).when(F.size(points) > 1, _let(cumulative_metres(points), place))


def between(points: Column, start: Column, stop: Column) -> Column:
    """The part of the line from `start` to `stop` metres, with interpolated ends."""
    kept = lambda cum: F.transform(F.filter(F.arrays_zip(points.alias("p"), cum.alias("m")), lambda x: (x["m"] > start) & (x["m"] < stop)), lambda x: x["p"])
    return F.concat(F.array(point_at(points, start)), _let(cumulative_metres(points), kept), F.array(point_at(points, stop)))


def metres_along(points: Column, lng: Column, lat: Column) -> Column:
    """Distance along the line of its place nearest to a point; the earlier of equally near places, null below two points."""

    def nearest(cum: Column) -> Column:
        def step(a: Column, b: Column) -> Column:
            t = geo.segment_fraction(lng, lat, a["lng"], a["lat"], b["lng"], b["lat"])
            return F.struct(geo.point_segment_metres(lng, lat, a["lng"], a["lat"], b["lng"], b["lat"]).alias("off"), t.alias("t"))

        spots = F.transform(_pairs(points, step), lambda s, i: F.struct(s["off"].alias("off"), (F.get(cum, i) + s["t"] * (F.get(cum, i + 1) - F.get(cum, i))).alias("m")))
        return F.array_min(spots)["m"]

    return F.when(F.size(points) > 1, _let(cumulative_metres(points), nearest))


def joined(a: Column, b: Column) -> Column:
    """Both lines as one, equal neighbours once."""
    add = lambda s, p: F.when((F.size(s) > 0) & (F.element_at(s, -1) == p), s).otherwise(F.concat(s, F.array(p)))
    return F.aggregate(F.concat(a, b), F.slice(a, F.lit(1), F.lit(0)), add)


def inserted(points: Column, place: Column, point: Column) -> Column:
    """The line with a point put before the point that stands at `place` (from 0)."""
    return F.concat(F.slice(points, F.lit(1), place), F.array(point), F.slice(points, place + 1, F.size(points)))


def shifted(points: Column) -> Column:
    """The line in the shifted coordinate system."""
    return F.transform(points, lambda p: geo.to_gcj02(p["lng"], p["lat"]))


def bounds(points: Column) -> Column:
    """struct<min_lng, max_lng, min_lat, max_lat>."""
    x, y = F.transform(points, lambda p: p["lng"]), F.transform(points, lambda p: p["lat"])
    return F.struct(F.array_min(x).alias("min_lng"), F.array_max(x).alias("max_lng"), F.array_min(y).alias("min_lat"), F.array_max(y).alias("max_lat"))


def _planar(points: Column) -> Column:
    """Planar degrees from the start to each point."""
    steps = _pairs(points, lambda a, b: F.hypot(b["lng"] - a["lng"], b["lat"] - a["lat"]))
    return F.aggregate(steps, F.array(F.lit(0.0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))


def share_along(points: Column, lng: Column, lat: Column, most: float = 2.0) -> Column:
    """Where a point projects on the line, as a share of its planar length in degrees; null beyond `most` metres from it, or
    below two points; of equally near places the first; 0 on a line without length."""

    def nearest(cum: Column) -> Column:
        def step(a: Column, b: Column) -> Column:
            t = geo.segment_fraction(lng, lat, a["lng"], a["lat"], b["lng"], b["lat"])
            x, y = geo.interpolate(a["lng"], b["lng"], t), geo.interpolate(a["lat"], b["lat"], t)
            return F.struct(F.hypot(x - lng, y - lat).alias("off"), t.alias("t"), geo.haversine(lng, lat, x, y).alias("m"))

        spots = F.transform(_pairs(points, step), lambda s, i: F.struct(s["off"].alias("off"), (F.get(cum, i) + s["t"] * (F.get(cum, i + 1) - F.get(cum, i))).alias("at"), s["m"].alias("m")))
        whole = F.element_at(cum, -1)
        share = lambda best: F.when(best["m"] <= most, F.when(whole == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), best["at"] / F.nullif(whole, F.lit(0.0))))))
        return _let(F.array_min(spots), share)

    return F.when(F.size(points) > 1, _let(_planar(points), nearest))


def between_shares(points: Column, start: Column, stop: Column) -> Column:
    """The part of the line between two shares of its planar length, with interpolated ends."""

    def part(cum: Column) -> Column:
        whole = F.element_at(cum, -1)

        def place(share: Column) -> Column:
            at = share * whole
            i = F.greatest(F.lit(1), F.least(F.size(F.filter(cum, lambda c: c <= at)), F.size(points) - 1))
            a, b = F.element_at(points, i), F.element_at(points, i + 1)
            t = F.coalesce((at - F.element_at(cum, i)) / F.nullif(F.element_at(cum, i + 1) - F.element_at(cum, i), F.lit(0.0)), F.lit(0.0))
            return F.struct(geo.interpolate(a["lng"], b["lng"], t).alias("lng"), geo.interpolate(a["lat"], b["lat"], t).alias("lat"))

        inner = F.transform(F.filter(F.arrays_zip(points.alias("p"), cum.alias("m")), lambda x: (x["m"] > start * whole) & (x["m"] < stop * whole)), lambda x: x["p"])
        return F.concat(F.array(place(start)), inner, F.array(place(stop)))

    return F.when(F.size(points) > 1, _let(_planar(points), part))


def reversed_line(points: Column) -> Column:
    return F.reverse(points)


def shifted_rings(rings: Column, back: bool = False) -> Column:
    """Rings of a polygon, array<array<struct<lng, lat>>>, in the shifted system, or back from it."""
    turn = geo.to_wgs84 if back else geo.to_gcj02
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: turn(p["lng"], p["lat"])))
