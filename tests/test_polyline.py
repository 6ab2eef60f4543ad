"""Polyline functions and choices along a route on small cases."""

import math

from pyspark.sql import functions as F

from wayfold.functions import polyline
from wayfold.operators import choices


def metres(a, b):
    x, y, u, v = map(math.radians, (*a, *b))
    return 2 * 6371008.8 * math.asin(math.sqrt(math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2))


LINE = [(116.0, 39.6), (116.01, 39.6), (116.01, 39.61)]


def lines(spark, points=LINE):
    return spark.createDataFrame([(points,)], "p array<struct<lng double, lat double>>")


def test_measures_and_parts(spark):
    p, first, whole = F.col("p"), metres(LINE[0], LINE[1]), metres(LINE[0], LINE[1]) + metres(LINE[1], LINE[2])
    row = lines(spark).select(
        polyline.cumulative_metres(p).alias("cum"),
        polyline.point_at(p, F.lit(first / 2)).alias("mid"),
        polyline.point_at(p, F.lit(1e9)).alias("end"),
        polyline.between(p, F.lit(first / 2), F.lit(first + 1.0)).alias("part"),
        polyline.metres_along(p, F.lit(116.0105), F.lit(39.605)).alias("along"),
        polyline.joined(p, F.reverse(p)).alias("back"),
        polyline.inserted(p, F.lit(1), F.struct(F.lit(1.0).alias("lng"), F.lit(2.0).alias("lat"))).alias("more"),
        polyline.bounds(p).alias("box"),
    ).first()
    assert [round(x, 6) for x in row["cum"]] == [0, round(first, 6), round(whole, 6)]
    assert abs(row["mid"]["lng"] - 116.005) < 1e-9 and tuple(row["end"]) == LINE[2]
    assert len(row["part"]) == 3 and tuple(row["part"][1]) == LINE[1]
    assert abs(row["along"] - (first + (whole - first) / 2)) < 0.5
    assert [tuple(x) for x in row["back"]] == [*LINE, LINE[1], LINE[0]]
    assert [tuple(x) for x in row["more"]] == [LINE[0], (1.0, 2.0), *LINE[1:]] and tuple(row["box"]) == (116.0, 116.01, 39.6, 39.61)
    short = lines(spark, LINE[:1]).select(polyline.point_at(p, F.lit(5.0)).alias("a"), polyline.metres_along(p, F.lit(1.0), F.lit(1.0)).alias("b")).first()
    assert tuple(short["a"]) == LINE[0] and short["b"] is None


def test_choices(spark):
    spots = spark.createDataFrame([(1, 10.0, 100.0), (1, 20.0, 260.0), (1, 30.0, 400.0), (2, 10.0, 90.0), (2, 40.0, 120.0), (2, 50.0, 120.0)], "route_id int, along_m double, clearance double")
    assert {tuple(r) for r in choices.reference_spot(spots).collect()} == {(1, 20.0, 260.0), (2, 40.0, 120.0)}
    assert {tuple(r) for r in choices.closest_to(spots, 25.0).collect()} == {(1, 20.0), (2, 10.0)}
    runs = spark.createDataFrame([(1, 1, True, False, False), (1, 2, True, True, False), (1, 3, False, True, True), (1, 4, True, True, False), (2, 1, False, False, False)], "route_id int, run int, inside boolean, mainline boolean, released boolean")
    assert {tuple(r) for r in choices.phase_violations(runs).collect()} == {(1, 2), (1, 4), (2, 1)}
    views = spark.createDataFrame([(1, k, z, x, 0.0, 1.0, 1.0) for k, z, x in ((1, 3, 0.0), (2, 3, 0.05), (3, 3, 0.2), (4, 4, 0.2))], "session int, seq int, zoom int, lng double, lat double, span_lng double, span_lat double")
    assert [r["seq"] for r in choices.viewport_changes(views).orderBy("seq").collect()] == [1, 3, 4]
    entries = spark.createDataFrame([(9, "a", 1), (9, "b", 2)], "node long, entry_id string, last_edge long")
    exits = spark.createDataFrame([(9, "x", 3)], "node long, exit_id string, first_edge long")
    banned = spark.createDataFrame([(2, 9, 3)], "from_edge long, via_node long, to_edge long")
    assert [tuple(r) for r in choices.through_paths(entries, exits, banned).collect()] == [(9, "a", "x")]
