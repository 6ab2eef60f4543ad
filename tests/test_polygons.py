"""Unions of areas against their invariants and against places inside and outside."""

import math
import random

import pytest

from wayfold.operators import polygons, spatial

SIDES = "part long, ring long, seq long, ax double, ay double, bx double, by double"


def sides(part, *rings):
    return [(part, r, k, *a, *b) for r, ring in enumerate(rings) for k, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True))]


def box(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d)]


@pytest.mark.parametrize(
    ("parts", "outer", "holes", "area", "touch"),
    [
        ([box(0.0, 0.0, 1.0, 1.0)], 1, 0, 1.0, True),
        ([box(0.0, 0.0, 1.0, 1.0), box(1.0, 0.0, 2.0, 1.0)], 1, 0, 2.0, True),  # a common side
        ([box(0.0, 0.0, 1.0, 1.0), box(1.0, 0.25, 2.0, 0.5)], 1, 0, 1.25, True),  # a part of a side
        ([box(0.0, 0.0, 1.0, 1.0), box(0.5, 0.5, 2.0, 2.0)], 1, 0, 3.0, False),  # crossing
        ([box(0.0, 0.0, 1.0, 1.0), box(1.0, 1.0, 2.0, 2.0)], 2, 0, 2.0, True),  # a common corner
        ([box(0.0, 0.0, 3.0, 3.0), box(1.0, 1.0, 2.0, 2.0)], 1, 0, 9.0, False),  # one within the other
        ([box(0.0, 0.0, 3.0, 1.0), box(0.0, 2.0, 3.0, 3.0), box(0.0, 1.0, 1.0, 2.0), box(2.0, 1.0, 3.0, 2.0)], 1, 1, 8.0, True),  # a hole between four
        ([[(0.0, 0.0), (2.0, 0.0), (1.0, 1.5)], [(0.0, 1.0), (1.0, -0.5), (2.0, 1.0)]], 1, 0, None, False),  # a star
    ],
)
def test_unions(spark, parts, outer, holes, area, touch):
    rows = spark.createDataFrame([x for k, p in enumerate(parts) for x in sides(k, p)], SIDES)
    rings = polygons.rings_of(polygons.union_border(rows, cell=0.3))
    report = polygons.union_report(rows, rings).first()
    assert (report["outer"], report["holes"], report["only_touch"]) == (outer, holes, touch)
    if area is not None:
        assert math.isclose(report["area"], area, abs_tol=1e-12)


def test_a_part_with_a_hole_and_one_that_fills_it(spark):
    ring = sides(1, box(0.0, 0.0, 3.0, 3.0), box(1.0, 1.0, 2.0, 2.0))
    for more, holes, area in (([], 1, 8.0), (sides(2, box(1.0, 1.0, 2.0, 2.0)), 0, 9.0), (sides(2, box(1.25, 1.25, 1.5, 1.5)), 1, 8.0625)):
        rows = spark.createDataFrame(ring + more, SIDES)
        report = polygons.union_report(rows, polygons.rings_of(polygons.union_border(rows))).first()
        assert (report["holes"], report["only_touch"]) == (holes, True)
        assert math.isclose(report["area"], area, abs_tol=1e-12)
    assert polygons.union_border(spark.createDataFrame([], SIDES)).count() == 0


def test_places_lie_in_the_union_as_in_its_parts(spark):
    rnd = random.Random(5)
    parts = []
    for k in range(6):
        cx, cy = rnd.uniform(0, 1), rnd.uniform(0, 1)
        parts += sides(k, [(cx + rnd.uniform(0.1, 0.5) * math.cos(2 * math.pi * i / 9), cy + rnd.uniform(0.1, 0.5) * math.sin(2 * math.pi * i / 9)) for i in range(9)])
    rows = spark.createDataFrame(parts, SIDES)
    border = polygons.union_border(rows, cell=0.1).selectExpr(*(f"{a} / 1e9 as {b}" for a, b in (("x1", "ax"), ("y1", "ay"), ("x2", "bx"), ("y2", "by"))))
    places = [(i, rnd.uniform(-0.6, 1.6), rnd.uniform(-0.6, 1.6)) for i in range(800)]
    found = spatial.locate(spark.createDataFrame(places, "id long, lng double, lat double"), border, ["id"], cell=0.1).collect()

    def inside(x, y, part):
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for p, _, _, ax, ay, bx, by in parts if p == part) % 2 == 1

    for r in found:
        assert (r["location"] == "INSIDE") == any(inside(r["lng"], r["lat"], k) for k in range(6)), (r["lng"], r["lat"])


def test_boundary_file_of_four_roles_is_what_its_reader_wants(spark, tmp_path):
    from pyspark.sql import functions as F

    from wayfold.operators import topology
    from wayfold.sources.points import ROLES, boundary_problems, read_boundary

    rows = spark.createDataFrame(sides(0, box(0.0, 0.0, 1.0, 1.0)) + sides(1, box(1.0, 0.0, 2.0, 1.0)), SIDES)
    rings = polygons.rings_of(polygons.union_border(rows))
    four = rings.withColumn("role", F.explode(F.array(*map(F.lit, ROLES))))
    (tmp_path / "b.json").write_text(topology.boundary_json(four, "a" * 64, True, tuple(ROLES)).first()["value"])
    assert boundary_problems(spark, str(tmp_path / "b.json"), "a" * 64).count() == 0
    back = read_boundary(spark, str(tmp_path / "b.json"), "a" * 64)
    assert back.groupBy("role").count().count() == 4
    assert back.where("role = 'controlled_area'").count() == rings.count()
    with pytest.raises(Exception, match="no ring of provincial_border"):
        topology.boundary_json(four.where("role <> 'provincial_border'"), "a" * 64, True, tuple(ROLES)).collect()


def test_long_rings_are_numbered_in_few_rounds_and_without_a_group(spark, monkeypatch):
    """A ring of 3,000 pieces, one of 4 and a single node: seq goes round from the least node, in rounds as the logarithm of the length."""
    from wayfold.operators import graph

    cut, rounds = graph._cut, []
    monkeypatch.setattr(graph, "_cut", lambda df, name: rounds.append(name) or cut(df, name))
    walks = [random.Random(3).sample(range(3000), 3000), [5003, 5001, 5002, 5000], [7000]]
    links = [(n, w[(i + 1) % len(w)], n % 7) for w in walks for i, n in enumerate(w)]
    found = {r["node"]: (r["first"], r["seq"]) for r in graph.cycles(spark.createDataFrame(links, "node long, next long, x long"), "x").collect()}
    wanted = {}
    for w in walks:
        k = w.index(min(w, key=lambda n: (n % 7, n)))
        wanted |= {n: (w[k], i) for i, n in enumerate(w[k:] + w[:k])}
    assert found == wanted and len(rounds) <= 15
    long = polygons.rings_of(spark.createDataFrame([(i, 0, i + 1, 0) for i in range(500)] + [(500, 0, 500, 9), (500, 9, 0, 9), (0, 9, 0, 0)], "x1 long, y1 long, x2 long, y2 long"))
    assert [(r["seq"], round(r["lng"] * polygons.UNITS), round(r["lat"] * polygons.UNITS)) for r in long.orderBy("seq").collect()] == [*((i, i, 0) for i in range(501)), (501, 500, 9), (502, 0, 9), (503, 0, 0)]
    assert "MapInPandas" not in long._jdf.queryExecution().toString() and "FlatMapGroups" not in long._jdf.queryExecution().toString()


def test_sides_of_a_cell_are_dealt_and_met_by_their_boxes(spark):
    rows = spark.createDataFrame([x for k in range(40) for x in sides(k, box(k * 0.01, 0.0, k * 0.01 + 0.01, 0.01))], SIDES)
    plan = polygons.cut_borders(rows)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [cell" in plan
    assert polygons.union_border(rows).count() == 82
