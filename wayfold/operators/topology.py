"""Topology of roads and areas: identities, modes, bypasses, anchored ways, boundary transitions, rings and their files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators import graph, search


def relation_ways(ways: DataFrame, members: DataFrame, relations: DataFrame, tags: dict[str, str]) -> DataFrame:
    """ways (way_id, highway) with `identity`: motorways that are members of a relation with all the given tags."""
    wanted = relations.where(" and ".join(f"tags['{k}'] = '{v}'" for k, v in sorted(tags.items()))).select("relation_id")
    own = members.join(wanted, "relation_id", "left_semi").select("way_id").distinct().withColumn("member", F.lit(True))
    return ways.join(own, "way_id", "left").withColumn("identity", F.coalesce(F.col("member") & (F.col("highway") == "motorway"), F.lit(False))).drop("member")


def planning_mode(start: Column, end: Column) -> Column:
    """How a request is planned, by the places of its ends: inside, outside, crossing out or in, or ambiguous on the boundary."""
    both = F.concat_ws(">", start, end)
    return F.when((start == "BOUNDARY") | (end == "BOUNDARY"), "AMBIGUOUS").when(both == "INSIDE>INSIDE", "INTERNAL").when(both == "OUTSIDE>OUTSIDE", "EXTERNAL").when(both == "INSIDE>OUTSIDE", "OUTBOUND").when(both == "OUTSIDE>INSIDE", "INBOUND")


def checkpoint_bypasses(edges: DataFrame, limit_mm: int = 3_000_000) -> DataFrame:
    """(edge_id, component): drivable edges off the mainline around closed mainline stretches.

    edges: edge_id, u, v, len_mm, mainline, access. A component of closed mainline edges counts if exactly two of its nodes
    touch open mainline; an edge bypasses it if both its nodes lie within `limit_mm` of both ends over open edges that aren't
    mainline, and the ends share two nodes or more.
    """
    shut, main = edges.where("mainline and not access"), edges.where("mainline and access")
    parts = graph.components(shut.select(F.col("u").alias("a"), F.col("v").alias("b")))
    touch = main.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    ends = parts.join(touch, "node", "left_semi").groupBy("component").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n")).where("n = 2")
    ways = edges.where("access and not mainline")
    seeds = ends.select("component", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("first").alias("node")), F.struct(F.lit(1).alias("side"), F.col("last").alias("node")))).alias("e")).select((F.col("component") * 2 + F.col("e.side")).alias("request"), "e.node")
    reach = graph.node_reach(seeds, ways.select("u", "v", "len_mm"), limit_mm)
    shared = reach.groupBy(F.expr("request div 2").alias("component"), "node").agg(F.count_distinct("request").alias("n")).where("n = 2").select("component", "node")
    enough = shared.groupBy("component").agg(F.count("*").alias("n")).where("n >= 2").select("component")
    shared = shared.join(enough, "component")
    met = ways.join(shared.select(F.col("node").alias("u"), "component"), "u").join(shared.select(F.col("node").alias("v"), "component"), ["v", "component"])
    return met.select("edge_id", "component")


def anchored_ways(requests: DataFrame, turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(request, dist_mm): the shortest way from one directed key to another, both wholly used. requests: request, first_key, last_key.

    Each row is a search of its own, for the end of its last key, and goes no further than that."""
    rows = graph._cut(requests.select("request", "first_key", "last_key").withColumn("row", F.monotonically_increasing_id()), "anchored")
    seeds = rows.join(lengths.select(F.col("key").alias("first_key"), "len_mm"), "first_key").select(F.col("row").alias("request"), F.col("first_key").alias("key"), F.col("len_mm").alias("dist_mm"))
    ends = rows.select(F.col("row").cast("string").alias("target"), F.col("last_key").alias("key"), F.lit(0).alias("back_mm"), F.col("row").alias("request"))
    found = search.target_search(seeds, turns, ends, step_mm=0, tiers=1, local=True).targets
    return found.select(F.col("request").alias("row"), "dist_mm").join(rows, "row").select("request", "dist_mm")


def boundary_transitions(starts: DataFrame, keys: DataFrame, turns: DataFrame, on_boundary: DataFrame) -> DataFrame:
    """(request, key, hops): keys that leave the boundary, by the fewest steps along keys between boundary nodes.

    starts: request, key (a key that arrives on the boundary); on_boundary: node; turns: legal (key, next_key).
    """
    ends = keys.join(on_boundary.withColumnRenamed("node", "to_node"), "to_node", "left_semi").select("key")
    # only from keys that end on the boundary does the search go on
    steps = turns.join(ends, "key", "left_semi").select("key", "next_key", F.lit(1).cast("bigint").alias("next_mm"))
    found = graph.shortest_paths(starts.select("request", "key", F.lit(0).cast("bigint").alias("dist_mm")), steps)
    return found.join(ends, "key", "left_anti").select("request", "key", F.col("dist_mm").alias("hops"))


def closed_rings(segments: DataFrame) -> DataFrame:
    """(ring, seq, lng, lat): the closed rings that undirected segments (ax, ay, bx, by) make, each from its least point.

    Points are joined at 1e-9 degrees. A component is a ring if all its points have two segments; other lines are left out.
    A ring is walked in one group, so it should fit a task, as the boundaries of areas do.
    """
    at = lambda x, y: F.xxhash64(F.round(F.col(x) * 1e9).cast("bigint"), F.round(F.col(y) * 1e9).cast("bigint"))
    lines = segments.select(at("ax", "ay").alias("a"), at("bx", "by").alias("b"), "ax", "ay", "bx", "by").where("a <> b").dropDuplicates(["a", "b"])
    parts = graph.components(lines.select("a", "b"))
    degree = lines.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    whole = parts.join(degree, "node").groupBy("component").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low = 2 and high = 2").select("component")
    rows = lines.join(parts.withColumnRenamed("node", "a"), "a").join(whole, "component", "left_semi")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        place = {**{r.a: (r.ax, r.ay) for r in pdf.itertuples()}, **{r.b: (r.bx, r.by) for r in pdf.itertuples()}}
        near: dict[int, list[int]] = {}
        for r in pdf.itertuples():
            near.setdefault(r.a, []).append(r.b)
            near.setdefault(r.b, []).append(r.a)
        first = min(place, key=place.get)
        order, before, now = [first], first, min(near[first], key=place.get)
        while now != first:
            order.append(now)
            before, now = now, next((n for n in near[now] if n != before), first)
        order.append(first)
        return pd.DataFrame({"ring": pdf["component"].iloc[0], "seq": range(len(order)), "lng": [place[k][0] for k in order], "lat": [place[k][1] for k in order]})

    return rows.groupBy("component").applyInPandas(walk, "ring bigint, seq int, lng double, lat double")


def ring_areas(rings: DataFrame) -> DataFrame:
    """(ring, area, points): shoelace areas in square degrees, and the numbers of points."""
    w = Window.partitionBy("ring").orderBy("seq")
    step = rings.withColumn("nx", F.lead("lng").over(w)).withColumn("ny", F.lead("lat").over(w))
    return step.groupBy("ring").agg((F.abs(F.sum(F.col("lng") * F.col("ny") - F.col("nx") * F.col("lat"))) / 2).alias("area"), F.count("*").alias("points"))


def boundary_json(roles: DataFrame, source_hash: str, approved: bool = False, required: tuple[str, ...] = ()) -> DataFrame:
    """One row, `value`: a GeoJSON FeatureCollection of polygons by role from rows (role, ring, seq, lng, lat); write it with
    df.write.text().

    The file names its source by hash and whether it is approved, and each feature the hash of its own coordinates. A role of
    `required` that has no ring is an error. A boundary file is one value, as its readers want it; a role's rings must fit a task."""
    rings = roles.groupBy("role", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lng", "lat"))), lambda p: F.array(p["lng"], p["lat"])).alias("points"))
    shapes = rings.groupBy("role").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda r: r["points"]).alias("rings"))
    properties = F.struct("role", F.sha2(F.to_json("rings"), 256).alias("sha256")) if required else F.struct("role")
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates")).alias("geometry"))
    all_of = shapes.agg(F.transform(F.array_sort(F.collect_list(F.struct("role", feature.alias("f")))), lambda x: x["f"]).alias("features"))
    lost = F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), F.transform("features", lambda f: f["properties"]["role"]))
    kept = F.when(F.size(lost) > 0, F.raise_error(F.concat(F.lit("no ring of "), F.array_join(lost, ", "))).cast(all_of.schema["features"].dataType)).otherwise(F.col("features"))
    head = {"type": "FeatureCollection", "schemaVersion": 4, "coordinateSystem": "WGS84", "sourceSha256": source_hash, "sourcePbfSha256": source_hash, "approvedForProduction": approved}
    return all_of.select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in head.items()), kept.alias("features"))).alias("value"))


def boundary_report(rings: DataFrame) -> DataFrame:
    """`value`: a line of text for each ring, largest first."""
    return ring_areas(rings).orderBy(F.desc("area"), "ring").select(F.format_string("ring %d: %d points, %.9f square degrees", "ring", "points", "area").alias("value"))
