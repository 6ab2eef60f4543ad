"""Places against polygons by cells, and edges by geometry, against every segment."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import areas, spatial

SEGMENT = "ax double, ay double, bx double, by double"


def star(rnd, cx, cy, radius, n):
    at = [(cx + radius * rnd.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), cy + radius * rnd.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return [(*a, *b) for a, b in zip(at, at[1:] + at[:1], strict=True)]


def plain(x, y, segments):
    """(location, squared degrees) by the ray and by all segments."""
    on = any(abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) <= 1e-12 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by) for ax, ay, bx, by in segments)
    n = sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for ax, ay, bx, by in segments)

    def square(ax, ay, bx, by):
        size = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / size)) if size else 0
        return (x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2

    return "BOUNDARY" if on else "INSIDE" if n % 2 else "OUTSIDE", min(square(*s) for s in segments)


@pytest.mark.parametrize(("seed", "n", "cell"), [(1, 6, 0.01), (2, 300, 0.03), (3, 40, 5.0)])
def test_places_by_cells_as_by_all_segments(spark, seed, n, cell):
    rnd = random.Random(seed)
    segments = star(rnd, 116, 39, 0.4, n) + star(rnd, 116.02, 39.01, 0.05, 7) + star(rnd, 117.5, 39.5, 0.2, n)
    segments += [(118.0, 39.0, 118.5, 39.0), (118.5, 39.0, 118.5, 39.4), (118.5, 39.4, 118.0, 39.4), (118.0, 39.4, 118.0, 39.0)]
    places = [(rnd.uniform(115.4, 118.8), rnd.uniform(38.4, 39.9)) for _ in range(1200)] + [(rnd.uniform(-170, 170), rnd.uniform(-80, 80)) for _ in range(30)]
    places += [s[:2] for s in segments[:20]] + [(118.2, 39.0), (118.5, 39.2), (118.0, 39.4), (118.1, 39.1), (117.9, 39.0), (118.1, 39.4 + 1e-9)] + [(116.0, 39.0)] * 40
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id long, lng double, lat double")
    found = {r["id"]: r for r in spatial.locate(points, spark.createDataFrame(segments, SEGMENT), ["id"], cell).collect()}
    assert len(found) == len(places)
    for i, p in enumerate(places):
        location, square = plain(*p, segments)
        assert found[i]["location"] == location, p
        assert math.isclose(found[i]["near_deg"], math.sqrt(square), rel_tol=1e-9, abs_tol=1e-12)
        assert (found[i]["outside_m"] > 0) == (location == "OUTSIDE")


def test_no_nested_loops_and_odd_rows(spark):
    segments = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 1.0, 1.0), (1.0, 1.0, 0.0, 0.0)], SEGMENT)
    points = spark.createDataFrame([(1, 0.7, 0.2), (2, None, 0.2), (3, 5.0, 5.0)], "id long, lng double, lat double")
    found = spatial.locate(points, segments, ["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r["id"]: r["location"] for r in found.collect()} == {1: "INSIDE", 2: "OUTSIDE", 3: "OUTSIDE"}
    assert spatial.locate(points.limit(0), segments, ["id"]).count() == 0
    assert {r["near_deg"] for r in spatial.locate(points, segments.limit(0), ["id"]).collect()} == {None}


def test_classes_by_geometry_and_identity(spark):
    box = lambda a, b, c, d: [(a, b, c, b), (c, b, c, d), (c, d, a, d), (a, d, a, b)]
    inner, second = (spark.createDataFrame(x, SEGMENT) for x in (box(0.0, 0.0, 1.0, 1.0), box(1.0, 0.0, 2.0, 1.0)))
    rows = [  # edge, line, class, link, identity
        (1, 0.2, 0.2, 0.8, 0.2, "motorway", False, False), (2, 0.9, 0.5, 1.5, 0.5, "motorway", False, False), (3, 1.2, 0.5, 1.8, 0.5, "motorway", False, False), (4, 1.5, 0.5, 2.5, 0.5, "motorway", False, False),
        (5, 1.0, 0.2, 1.0, 0.8, "motorway", False, True), (6, 0.0, 0.2, 0.0, 0.8, "motorway", True, True), (7, 1.2, 0.6, 1.8, 0.6, "motorway", True, False), (8, 3.0, 3.0, 4.0, 4.0, "primary", False, False), (9, 1.0, 0.1, 1.5, 0.1, "primary", False, False),
    ]
    edges = spark.createDataFrame(rows, "edge_id long, ulng double, ulat double, vlng double, vlat double, road_class string, is_link boolean, identity boolean")
    edges = edges.withColumns({"way_id": F.col("edge_id") % 3, "forward": F.lit(True), "reverse": F.col("edge_id") % 2 == 0})
    got = areas.classify_edges(edges, inner, second)
    of = lambda c: {r["edge_id"] for r in got.where(c).collect()}
    assert of("in_inner") == {1, 2}
    assert of("in_second") == {3, 5, 7, 9}
    assert (of("ring"), of("mismatch"), of("exempt"), of("forbidden"), of("second_main"), of("link")) == ({5}, {6}, {3, 5}, {1, 2}, {3}, {6, 7})
    assert tuple(areas.classification_counts(got).first()) == (2, 1, 1, 1, 1, 1, 1, 1, 1, "relation and class differ")
