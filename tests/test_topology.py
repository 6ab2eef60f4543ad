"""Topology operators on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from wayfold.operators import graph, topology


def test_identities_and_modes(spark):
    ways = spark.createDataFrame([(1, "motorway"), (2, "primary"), (3, "motorway")], "way_id long, highway string")
    members = spark.createDataFrame([(9, 1), (9, 2), (8, 3), (9, 1)], "relation_id long, way_id long")
    relations = spark.createDataFrame([(9, {"type": "route", "ref": "G1"}), (8, {"type": "route", "ref": "G2"})], "relation_id long, tags map<string,string>")
    got = topology.relation_ways(ways, members, relations, {"type": "route", "ref": "G1"}).collect()
    assert {r["way_id"]: r["identity"] for r in got} == {1: True, 2: False, 3: False}
    ends = [("INSIDE", "INSIDE"), ("OUTSIDE", "OUTSIDE"), ("INSIDE", "OUTSIDE"), ("OUTSIDE", "INSIDE"), ("BOUNDARY", "INSIDE")]
    modes = spark.createDataFrame(ends, "a string, b string").select(topology.planning_mode(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r["m"] for r in modes] == ["INTERNAL", "EXTERNAL", "OUTBOUND", "INBOUND", "AMBIGUOUS"]


def test_bypass(spark):
    rows = [(1, 0, 1, 100, True, True), (2, 1, 2, 100, True, False), (3, 2, 3, 100, True, True), (4, 1, 10, 100, False, True), (5, 10, 2, 100, False, True), (6, 10, 11, 9_000_000, False, True)]
    edges = spark.createDataFrame(rows, "edge_id long, u long, v long, len_mm long, mainline boolean, access boolean")
    assert {tuple(r) for r in topology.checkpoint_bypasses(edges).collect()} == {(4, 1), (5, 1)}


def test_anchored_and_boundary_ways(spark):
    keys = spark.createDataFrame([(0, 0, 1, 2, 10), (2, 1, 2, 3, 20), (4, 2, 3, 4, 30), (6, 3, 2, 4, 100)], "key long, edge_id long, from_node long, to_node long, len_mm long")
    turns = graph.adjacency(keys, spark.createDataFrame([], "from_edge long, via_node long, to_edge long"))
    requests = spark.createDataFrame([(1, 0, 4), (2, 0, 6), (3, 4, 0)], "request long, first_key long, last_key long")
    assert {tuple(r) for r in topology.anchored_ways(requests, turns, keys).collect()} == {(1, 60), (2, 110)}
    starts = spark.createDataFrame([(7, 0)], "request long, key long")
    nodes = spark.createDataFrame([(2,), (3,)], "node long")
    assert {tuple(r) for r in topology.boundary_transitions(starts, keys, turns, nodes).collect()} == {(7, 4, 2), (7, 6, 1)}


def test_anchored_ways_look_no_further_than_their_ends(spark, monkeypatch):
    keys = spark.createDataFrame([(2 * i, i, i, i + 1, 10) for i in range(30)], "key long, edge_id long, from_node long, to_node long, len_mm long")
    turns = graph.adjacency(keys, spark.createDataFrame([], "from_edge long, via_node long, to_edge long"))
    requests = spark.createDataFrame([(1, 0, 4), (1, 0, 6), (2, 8, 8), (3, 4, 0)], "request long, first_key long, last_key long")
    monkeypatch.setattr(graph, "shortest_paths", lambda *a, **k: pytest.fail("labels of the whole network"))
    assert sorted(tuple(r) for r in topology.anchored_ways(requests, turns, keys).collect()) == [(1, 30), (1, 40), (2, 10)]


def test_rings_and_their_files(spark, tmp_path):
    square = [((0.0, 0.0), (1.0, 0.0)), ((1.0, 1.0), (1.0, 0.0)), ((1.0, 1.0), (0.0, 1.0)), ((0.0, 1.0), (0.0, 0.0))]
    loose = [((5.0, 5.0), (6.0, 5.0)), ((6.0, 5.0), (7.0, 5.0))]
    segments = spark.createDataFrame([(*a, *b) for a, b in square + loose], "ax double, ay double, bx double, by double")
    rings = topology.closed_rings(segments)
    points = [(r["lng"], r["lat"]) for r in rings.orderBy("seq").collect()]
    assert points == [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    assert topology.ring_areas(rings).first()["area"] == 1.0
    made = json.loads(topology.boundary_json(rings.withColumn("role", F.lit("area")), "0" * 64).first()["value"])
    assert made["features"][0]["properties"] == {"role": "area"} and made["features"][0]["geometry"]["coordinates"][0][1] == [0.0, 1.0]
    assert "5 points" in topology.boundary_report(rings).first()["value"]
