"""Landing files, map extracts, features, settings and the service over a snapshot store."""

import hashlib
import json
import threading

import pytest
from pyspark.sql import functions as F

from wayfold.config import Settings
from wayfold.operators import areas, corridors, graph
from wayfold.plans import service
from wayfold.plans.snapshot import SnapshotStore
from wayfold.sources import landing
from wayfold.sources.points import read_point_records

OSM = """<osm>
<node id="1" lon="116.0" lat="39.0"/><node id="2" lon="116.01" lat="39.0"><tag k="barrier" v="toll_booth"/></node>
<node id="3" lon="116.02" lat="39.0"/><node id="4" lon="117.0" lat="40.0"><tag k="barrier" v="toll_booth"/></node>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="motorway"/><tag k="oneway" v="yes"/></way>
<way id="11"><nd ref="3"/><nd ref="1"/><tag k="highway" v="service"/><tag k="access" v="private"/></way>
<way id="12"><nd ref="3"/><nd ref="4"/><tag k="building" v="yes"/></way>
<relation id="20"><member type="way" ref="10" role=""/><member type="node" ref="1" role=""/><tag k="type" v="route"/></relation>
</osm>"""


def test_extract(spark, tmp_path):
    (tmp_path / "a.osm").write_text(OSM)
    got = landing.read_extract(spark, str(tmp_path / "a.osm"))
    assert {r["node_id"]: r["tags"] for r in got["nodes"].collect()} == {1: {}, 2: {"barrier": "toll_booth"}, 3: {}, 4: {"barrier": "toll_booth"}}
    assert [(r["relation_id"], r["ways"], r["tags"]) for r in got["relations"].collect()] == [(20, [10], {"type": "route"})]
    edges = {r["edge_id"]: r for r in landing.network_of(got["nodes"], got["ways"]).collect()}
    assert {(r["u"], r["v"], r["road_class"], r["car_access"], r["one_way"]) for r in edges.values()} == {(1, 2, "motorway", True, True), (2, 3, "motorway", True, True), (3, 1, "service", False, False)}
    assert {(r["node_id"], tuple(r["ways"])) for r in landing.toll_booths(got["nodes"], got["ways"]).collect()} == {(2, (10,)), (4, (12,))}
    nodes, ways = landing.within_box(got["nodes"], got["ways"], (115.9, 38.9, 116.015, 39.1))
    assert {r["way_id"] for r in ways.collect()} == {10, 11} and {r["node_id"] for r in nodes.collect()} == {1, 2, 3}


def test_landed_files_and_their_hashes(spark, tmp_path):
    for name, text in (("good", "[1]"), ("empty", ""), ("blank", " "), ("bad", "{"), ("large", "[" + "1," * 50 + "1]")):
        (tmp_path / f"{name}.json").write_text(text)
    got = {r["path"].rsplit("/", 1)[1]: r for r in landing.landed(spark, f"{tmp_path}/*.json", 60).collect()}
    assert {k: r["problem"] for k, r in got.items()} == {"good.json": None, "blank.json": "no JSON", "bad.json": "no JSON", "large.json": "too large"}
    good = hashlib.sha256(b"[1]").hexdigest()
    assert got["good.json"]["sha256"] == good
    files = spark.createDataFrame([("a", good), ("b", good), ("c", good), ("d", good)], "path string, sha256 string")
    side = spark.createDataFrame([("a.sha256", good.upper() + "\n"), ("b.sha256", "0" * 64), ("c.sha256", "zz")], "path string, value string")
    assert {r["path"]: r["verdict"] for r in landing.verified(files, side).collect()} == {"a": "OK", "b": "MISMATCH", "c": "MALFORMED", "d": "MISSING"}


def test_features(spark, tmp_path):
    shape = lambda kind, at, **tags: {"type": "Feature", "properties": tags, "geometry": {"type": kind, "coordinates": at}}
    rows = [shape("LineString", [[0, 0], [1, 0], [1, 1]], boundary="administrative", level="4"), shape("LineString", [[5, 5], [6, 6]]), shape("Polygon", [[[0, 0], [1, 0], [1, 1], [0, 0]]], wikidata="Q1", level="6")]
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": rows}))
    found = landing.features(spark, str(tmp_path / "f.json"))
    assert landing.line_segments(found).count() == 3
    assert {tuple(r) for r in landing.line_segments(found, {"level": "4"}).collect()} == {(0, 0, 1, 0), (1, 0, 1, 1)}
    assert landing.area_rings(found, {"wikidata": "Q1"}).count() == 4 and landing.area_rings(found, {"wikidata": "Q2"}).count() == 0


def test_point_wrappers_in_field_order_and_any_case(spark, tmp_path):
    cases = {'{"x": [9], "Items": [{"a": 1}], "data": [{"b": 2}]}': ['{"a":1}'], '{"data": {"no": 1}, "cameras": [{"c": 3}]}': ['{"c":3}'], '{"RECORDS": [{"d": 4}, 5]}': ['{"d":4}', "5"], '{"result": []}': [], "[7]": ["7"]}
    for k, (text, expected) in enumerate(cases.items()):
        (tmp_path / f"{k}.json").write_text(text)
        assert [r["json"] for r in read_point_records(spark, str(tmp_path / f"{k}.json")).orderBy("record_index").collect()] == expected
    for k, text in enumerate(('{"rows": [1]}', '"text"', "3")):
        (tmp_path / f"bad{k}.json").write_text(text)
        with pytest.raises(Exception, match="wraps"):
            read_point_records(spark, str(tmp_path / f"bad{k}.json")).collect()


def test_settings():
    assert Settings.from_env(env={"WAYFOLD_TIER_COUNT": "3", "WAYFOLD_BLOCK_METRES": "30"}) == Settings(tier_count=3, block_metres=30.0)
    with pytest.raises(ValueError, match="tier_count"):
        Settings(tier_count=0)


def test_service(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    own = service.Service(store)
    assert own.status() == {} and own.readiness(source="1") == {"snapshot": False, "versions": False}
    points = spark.createDataFrame([("a", 116.1, 39.9), ("b", 117.5, 39.9)], "id string, lng double, lat double")
    metrics = {"source": 2, "points": 2, "matched": 2, "blocked": 0}
    version, outcome = store.publish({"source": "1"}, {"points": points}, metrics)
    assert outcome == "PUBLISHED" and own.status()["version"] == version and own.readiness(source="1") == {"snapshot": True, "versions": True}
    assert [r["point_id"] for r in own.points_in_bbox((116, 39, 117, 40)).collect()] == ["a"]
    for bad in ((117, 39, 116, 40), (116, 39, 200, 40)):
        with pytest.raises(ValueError):
            own.points_in_bbox(bad)
    with pytest.raises(ValueError, match="system"):
        own.points_in_bbox((116, 39, 117, 40), "EPSG")
    gate = threading.Event()
    first = own.request_refresh(gate.wait)
    assert own.request_refresh(lambda: 1) is None
    gate.set()
    assert first.result(10) and own.request_refresh(lambda: 2).result(10) == 2
    lease = store.acquire()
    assert store.acquire() is None
    store.release(lease)
    assert store.acquire().fence == lease.fence + 1
    (tmp_path / "p.json").write_text("[]")
    assert store.backup(str(tmp_path / "p.json")) == store.backup(str(tmp_path / "p.json")) == hashlib.sha256(b"[]").hexdigest()


def test_graph_files(spark, tmp_path):
    edges = spark.createDataFrame([(1, True), (2, False)], "edge_id long, car_access boolean")
    root = str(tmp_path / "graph")
    assert service.check_graph(spark, root, "s", "1") == ["not built"]
    assert service.build_graph(edges, root, "s", "1") == service.build_graph(edges, root, "s", "1")
    assert service.check_graph(spark, root, "s", "1") == []


def test_area_problems(spark):
    ring = lambda k, pts: [(k, i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(pts, pts[1:]))]
    make = lambda rows: spark.createDataFrame(rows, "ring int, seq int, ax double, ay double, bx double, by double")
    square = ring(0, [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)])
    line = lambda *p: spark.createDataFrame([tuple(map(float, x)) for x in p], "lng double, lat double")
    assert service.area_problems(make(square), make(ring(0, [(1, 1), (4, 1), (2, 2), (1, 1)])), line((4, 2))).count() == 0
    bad = [r["problem"] for r in service.area_problems(make(square + ring(1, [(1, 1), (2, 1), (2, 2)])), make(ring(0, [(1, 3), (5, 1), (2, 3), (1, 3)])), line((3, 3))).collect()]
    assert len(bad) == 3 and any("closed: 1" in x for x in bad)


def test_side_intervals_along_the_boundary(spark):
    """An edge that runs in, along the boundary and out crosses there, as an overlap; a touch from within does not."""
    ring = [(0, 0, 0.0, 0.0, 4.0, 0.0), (0, 1, 4.0, 0.0, 4.0, 4.0), (0, 2, 4.0, 4.0, 2.0, 4.0), (0, 3, 2.0, 4.0, 2.0, 2.0), (0, 4, 2.0, 2.0, 0.0, 2.0), (0, 5, 0.0, 2.0, 0.0, 0.0)]
    segments = spark.createDataFrame(ring, "ring int, seq int, ax double, ay double, bx double, by double")
    # at y = 2: from the inside (x = 3) to x = 2, then along the boundary to x = 0, then outside
    edges = spark.createDataFrame([(1, 3.0, 2.0, -1.0, 2.0), (2, 1.0, 1.0, 3.0, 1.0)], "edge_id long, ulng double, ulat double, vlng double, vlat double")
    found = areas.side_intervals(edges, segments)
    assert [(r["side"], r["start"], r["stop"]) for r in found.where("edge_id = 1").orderBy("k").collect()] == [("INSIDE", 0.0, 0.25), ("BOUNDARY", 0.25, 0.75), ("OUTSIDE", 0.75, 1.0)]
    keys = spark.createDataFrame([(2, 1), (3, 1), (4, 2)], "key long, edge_id long")
    assert {(r["key"], r["direction"], r["kind"], r["fraction"]) for r in areas.directed_portals(found, keys).collect()} == {(2, "OUT", "OVERLAP", 0.75), (3, "IN", "OVERLAP", 0.75)}
    flags = {r["edge_id"]: (r["stays_within"], r["avoids_interior"]) for r in areas.area_flags(found).collect()}
    assert flags == {1: (False, False), 2: (True, False)}


def test_both_searches_give_the_same_rows_with_ties_and_times(spark):
    import random

    rnd = random.Random(4)
    turns = spark.createDataFrame([(rnd.randrange(40), rnd.randrange(40), rnd.randrange(0, 4), rnd.randrange(3)) for _ in range(160)], "key long, next_key long, next_mm long, next_ms long").where("key <> next_key")
    seeds = spark.createDataFrame([(1, 0, 0, 0), (1, 7, 2, 1), (2, 9, 50, 0), (2, 3, 1, 1)], "request long, key long, dist_mm long, ms long")
    for limit in (None, 10):
        near, far = (sorted(map(tuple, graph.shortest_paths(seeds, turns, limit, small).collect())) for small in (10_000, 1))
        assert near == far and near
    assert not [r for r in near if r[2] > 10]


def test_outside_distances_and_exit_keys(spark):
    links = spark.createDataFrame([(1, 0, 1, 5), (2, 1, 2, 7), (3, 8, 9, 1)], "edge_id long, u long, v long, len_mm long")
    far = corridors.outside_distances(links, spark.createDataFrame([(2,)], "node long"))
    assert {tuple(r) for r in far.collect()} == {(2, 0), (1, 7), (0, 12)}
    assert {tuple(r) for r in corridors.exit_keys(links, far).collect()} == {(1, 2), (2, 4)}


def test_text_functions(spark):
    from wayfold.functions import text

    rows = spark.createDataFrame([(None, "a"), (999.4, "b"), (9949.0, "c"), (12_345.0, "d"), (float("nan"), "e"), (-1.0, "f")], "m double, k string").orderBy("k")
    assert [r[0] for r in rows.select(text.distance_text(F.col("m"))).collect()] == ["--", "999 米", "9.9 公里", "12 公里", "--", "--"]
    assert [r[0] for r in rows.select(text.duration_text(F.col("m"))).collect()] == ["--", "17 分钟", "2 小时 46 分钟", "3 小时 26 分钟", "--", "--"]
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.described(F.array(*map(F.lit, ("North", " North Gate ", "Gate", "Road 5"))))) == "North GateRoad 5"
    assert one(text.version_text(F.lit("2024-03-04 05:06:07"))) == "03/04 05:06" and one(text.version_text(F.lit("x"))) == "x"
    at = lambda x, y: F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat"))
    assert one(text.handover_uri(F.lit(True), at(1.5, 2.5), at(3.0, 4.0), "https://uri.example/navigation")).endswith("?from=1.5%2C2.5%2Cinner+handover&to=3.0%2C4.0%2Couter+end&mode=car&policy=0&callnative=1")


def test_boundary_files_must_fit_their_network(spark, tmp_path):
    from wayfold.sources.points import ROLES, boundary_problems, read_boundary

    good = "a" * 64
    shape = lambda role: {"type": "Feature", "properties": {"role": role}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}
    whole = {"type": "FeatureCollection", "coordinateSystem": "WGS84", "sourcePbfSha256": good.upper(), "approvedForProduction": True, "schemaVersion": 4, "features": [shape(r) for r in ROLES]}
    cases = [({}, []), ({"coordinateSystem": "GCJ02"}, ["coordinate system is not WGS84"]), ({"sourcePbfSha256": "b" * 64}, ["made from another source"]), ({"approvedForProduction": None}, ["not approved"]),
             ({"features": whole["features"][:3]}, ["no provincial_border"]), ({"schemaVersion": None, "features": [shape("inside_boundary")]}, []), ({"sourcePbfSha256": "x"}, ["no hash of the source", "made from another source"])]
    for k, (change, problems) in enumerate(cases):
        path = str(tmp_path / f"{k}.json")
        (tmp_path / f"{k}.json").write_text(json.dumps(whole | change))
        assert [r["problem"] for r in boundary_problems(spark, path, good).collect()] == problems
        if problems:
            with pytest.raises(ValueError, match=problems[0]):
                read_boundary(spark, path, good)
        else:
            assert read_boundary(spark, path, good).count() > 0
    assert boundary_problems(spark, str(tmp_path / "3.json"), good, approved=False).count() == 0


def test_an_unmatched_hash_stops_the_job(spark):
    from wayfold.sources import landing

    rows = lambda *v: spark.createDataFrame([(f"p{i}", x) for i, x in enumerate(v)], "path string, verdict string")
    assert landing.only_verified(rows("OK", "OK")).count() == 2
    for bad in ("MISMATCH", "MISSING", "MALFORMED"):
        with pytest.raises(Exception, match=f"p1: {bad}"):
            landing.only_verified(rows("OK", bad)).collect()
