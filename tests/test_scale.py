"""Steps that grew faster than their input: what they join, and how many rows they join it for."""

from pyspark.sql import functions as F

from wayfold.operators import ordered, spatial
from wayfold.plans.catalog_builds import QUERIES

SF = "/root/testdata/sf0.001"
LINES = "edge_id long, ulng double, ulat double, vlng double, vlat double"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_runs_of_traces_are_never_broadcast(spark):
    """60 rows of a trace look like one customer to the planner: their joins must say that they are shuffled."""
    for name, on in (("link_chains", "edge_id"), ("trace_phases", "edge_id"), ("first_last_crossing", "edge_key")):
        assert f"SortMergeJoin [{on}" in plan(QUERIES[name](spark, SF)), name
    assert "Join LeftOuter" not in plan(QUERIES["trace_phases"](spark, SF)) and "LeftOuter" not in plan(QUERIES["trace_phases"](spark, SF))


def test_edges_take_cells_only_around_the_points(spark, monkeypatch):
    cells, made = spatial._cells, []
    monkeypatch.setattr(spatial, "_cells", lambda bounds, size: made.append(cells(bounds, size)) or made[-1])
    points = spark.createDataFrame([(1, 116.1, 39.7), (2, 116.3, 40.0)], "point_id long, lng double, lat double")
    rows = [(0, 116.1, 39.7, 116.11, 39.7), *((k, 116.1, 89.0 + k * 0.01, 116.11, 89.0 + k * 0.01) for k in range(1, 201))]
    edges = spark.createDataFrame(rows, LINES)
    met = spatial.points_to_edges(points, edges, 500.0)
    assert [(r["point_id"], r["edge_id"]) for r in met.collect()] == [(1, 0)]
    near = spatial._celled(edges, {"min_lng": F.col("ulng") - 0.5, "max_lng": F.col("vlng") + 0.5, "min_lat": F.col("ulat") - 0.005, "max_lat": F.col("ulat") + 0.005}, points, 0.005)
    assert {r["edge_id"] for r in near.collect()} == {0} and near.count() <= 42 * 3


def test_points_at_one_place_are_searched_for_once(spark, monkeypatch):
    meet, given = spatial.points_to_edges, []
    monkeypatch.setattr(spatial, "points_to_edges", lambda points, *rest: given.append(points.count()) or meet(points, *rest))
    rows = [(k, 116.1, 39.7) for k in range(100)] + [(100, 116.2, 39.8), (101, None, 39.7)]
    points = spark.createDataFrame(rows, "point_id long, lng double, lat double")
    edges = spark.createDataFrame([(7, 116.1, 39.7001, 116.11, 39.7001), (8, 116.2, 39.8001, 116.21, 39.8001)], LINES)
    found = {r["point_id"]: r["edge_id"] for r in spatial.nearest_edge(points, edges, "point_id").collect()}
    assert given == [2] and found == {**{k: 7 for k in range(100)}, 100: 8, 101: None}


def test_like_routes_are_matched_once_and_told_for_all(spark, monkeypatch):
    met = ordered.subsequence_matches
    given = []
    monkeypatch.setattr(ordered, "subsequence_matches", lambda runs, part: given.append(runs.select("route_id").distinct().count()) or met(runs, part))
    routes = QUERIES["corridor_match"](spark, SF)
    kinds = spark.read.parquet(f"{SF}/customer.parquet").selectExpr("c_custkey % 40 as k").distinct().count()
    assert given == [kinds] and routes.count() == routes.distinct().count() > 0


def test_blocked_edges_measure_places_and_not_points(spark, monkeypatch):
    """Three points at one place: one pair is measured, and all three are counted."""
    from wayfold.plans import catalog
    from wayfold.sources.fixtures import Network

    meet, given = spatial.points_to_edges, []
    monkeypatch.setattr(spatial, "points_to_edges", lambda points, *rest: given.append(points.count()) or meet(points, *rest))
    net = Network(spark, SF)
    net.points = spark.createDataFrame([(1, 116.015, 39.6), (2, 116.015, 39.6), (3, 116.015, 39.6)], "point_id long, lng double, lat double")
    rows = catalog.blocked(net).select("edge_id", "n_points").collect()
    assert given == [1] and [tuple(r) for r in rows] == [(2, 3)]


def test_rounding_by_arithmetic_is_that_of_round(spark):
    """Halves, values next to halves, signs, large values, NaN and null; the SQL of resample_20m says round()."""
    import math
    import random

    from wayfold.functions import geo

    rnd = random.Random(1)
    halves = [(k + 0.5) / 1e7 for k in (rnd.randrange(4 * 10**9) for _ in range(3000))]
    values = [rnd.uniform(-400, 400) for _ in range(20_000)] + halves + [math.nextafter(x, side) for x in halves for side in (-1e9, 1e9)] + [x + e for x in halves for e in (-2e-11, 2e-11)]
    values += [-x for x in values] + [0.0, -0.0, -1e-9, 116.1, 1e300, -1e18, 123456.78901235, float("inf"), float("nan"), None]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", geo.rounded(F.col("x"), 7).alias("a"), F.round("x", 7).alias("b")).collect()
    assert len(rows) == len(values) and [repr(r["x"]) for r in rows if repr(r["a"]) != repr(r["b"])] in ([], ["-0.0"])


def test_only_edges_around_an_area_are_cut_at_its_boundary(spark, monkeypatch):
    """A row of edges through a box, and 200 far from it: the roles are those of cutting all."""
    from wayfold.operators import areas

    cut, given = areas.side_intervals, []
    monkeypatch.setattr(areas, "side_intervals", lambda edges, segments: given.append(edges.count()) or cut(edges, segments))
    box = lambda x: spark.createDataFrame([(x, 0.0, x + 1, 0.0), (x + 1, 0.0, x + 1, 1.0), (x + 1, 1.0, x, 1.0), (x, 1.0, x, 0.0)], "ax double, ay double, bx double, by double")
    rows = [(k, k * 0.25 - 1, 0.5, k * 0.25 - 0.75, 0.5, "motorway", False, k % 2 == 0) for k in range(12)] + [(12, 2.5, 1.0, 2.75, 1.0, "motorway", False, False)]
    rows += [(100 + k, 20.0 + k, 0.5, 20.5 + k, 0.5, "motorway", False, k % 2 == 0) for k in range(200)]
    edges = spark.createDataFrame(rows, f"{LINES}, road_class string, is_link boolean, identity boolean")
    kept = lambda: {tuple(r) for r in areas.classify_edges(edges, box(0.0), box(2.0)).select("edge_id", "in_inner", "in_second", "ring", "mismatch", "exempt", "forbidden", "second_main").collect()}
    found = kept()
    assert len(given) == 2 and max(given) < 13 and len(found) == 213
    monkeypatch.setattr(areas, "around", lambda edges, segments: edges, raising=False)
    assert kept() == found and {r[0] for r in found if r[1]} and {r[0] for r in found if r[2]} == {12}
