"""Whole plans: blocked-edge snapshots from records and a network, and routes on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import graph, search, spatial
from wayfold.plans.snapshot import Gate, Lease, SnapshotStore
from wayfold.sources.points import ingest_points


def blocked_edges(points: DataFrame, edges: DataFrame, metres: float) -> tuple[DataFrame, DataFrame]:
    """(blocked, matches): edges that a point blocks (edge_id, n_points) and all pairs; exempt edges match but are never blocked."""
    found = spatial.points_to_edges(points.select(F.col("id").alias("point_id"), "lng", "lat"), edges, metres).select("point_id", "edge_id", "exempt", "dist_m")
    return found.where("not exempt").groupBy("edge_id").agg(F.count("*").alias("n_points")), found


def refresh(store: SnapshotStore, records: DataFrame, source_version: str, edges: DataFrame, network_version: str, metres: float = 50.0, gate: Gate | None = None, source: str | None = None) -> tuple[str, str]:
    """Ingests records, joins them with drivable edges (edge_id, ulng, ulat, vlng, vlat, exempt), gates and publishes.

    One transaction: the store's lease is held throughout, so nothing is built where another refresh runs (BUSY); source, the
    file that the records are from, is backed up before the new version goes into service."""
    with store.leased() as lease:
        if lease is None:
            return "", "BUSY"
        return _refresh(store, records, source_version, edges, network_version, metres, gate, source, lease)


def _refresh(store: SnapshotStore, records: DataFrame, source_version: str, edges: DataFrame, network_version: str, metres: float, gate: Gate | None, source: str | None, lease: Lease) -> tuple[str, str]:
    got = ingest_points(records)
    points = got.valid.select("id", F.col("wgs84.lng").alias("lng"), F.col("wgs84.lat").alias("lat"), "district", "address", "kind", "direction")
    blocked, pairs = blocked_edges(points, edges, metres)
    counts = got.metrics.first()
    metrics = {"source": counts["source_count"], "points": counts["valid_count"], "matched": pairs.agg(F.count_distinct("point_id")).first()[0], "blocked": blocked.count()}
    return store.publish({"source": source_version, "network": network_version, "metres": str(metres)}, {"points": points, "blocked": blocked, "issues": got.issues}, metrics, gate, source, lease)


def plan_routes(requests: DataFrame, edge_keys: DataFrame, forbidden: DataFrame, blocked: DataFrame, **far) -> DataFrame:
    """(request, dist_mm, keys): the shortest legal way of each request (request, from_node, to_node) as directed edge keys.

    Blocked edges (edge_id) and banned turns are never used; a request without a way has no row. Ties take the smaller key. Each
    search ends at its target.
    """
    stop = blocked.select(F.explode(F.array(2 * F.col("edge_id"), 2 * F.col("edge_id") + 1)).alias("key"))
    open_keys = edge_keys.join(stop, "key", "left_anti")
    starts = requests.withColumnRenamed("from_node", "start_node")
    seeds = starts.join(open_keys, starts["start_node"] == open_keys["from_node"]).select("request", "key", F.col("len_mm").alias("dist_mm"))
    ends = requests.select("request", "to_node").join(open_keys.select("key", "to_node"), "to_node").select("request", F.lit("end").alias("target"), "key", F.lit(0).alias("back_mm"))
    found = search.target_search(seeds, graph.adjacency(edge_keys, forbidden, stop), ends, step_mm=0, tiers=1, ways=True, local=True, **far)
    return found.targets.select("request", "dist_mm", "keys")


def plan_place_routes(requests: DataFrame, edges: DataFrame, keys: DataFrame, forbidden: DataFrame, blocked: DataFrame, most: float | None = None, **far) -> DataFrame:
    """(request, outcome, dist_mm, ms, keys, first_share, last_share): routes between places.

    requests: request, start and stop (struct<lng, lat>); edges: the edges that may be used (edge_id and the places of u and v);
    keys: their directed keys (key, edge_id, from_node, to_node, len_mm, ms). Both places are snapped to the nearest edge (within
    `most` metres); the route starts and ends within these edges, on either of their directed keys, with shares of their length
    and time. A request that can't be snapped, or only to a blocked edge, has the outcome INVALID; one whose search ends without a
    way NO_ROUTE; the others ROUTE. Blocked edges and banned turns are never used.
    """
    ends = requests.select("request", F.explode(F.array(F.struct(F.lit(0).alias("stop"), F.col("start").alias("at")), F.struct(F.lit(1).alias("stop"), F.col("stop").alias("at")))).alias("e"))
    places = ends.select((2 * F.col("request") + F.col("e.stop")).alias("place"), "e.at.lng", "e.at.lat")
    snaps = graph._cut(spatial.snapped(places, edges, "place", most), "route-places")
    stop = blocked.select(F.explode(F.array(2 * F.col("edge_id"), 2 * F.col("edge_id") + 1)).alias("key"))
    open_keys = keys.join(stop, "key", "left_anti")
    met = snaps.where("valid").join(open_keys, "edge_id")
    share = F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, 1 - F.col("fraction")).otherwise(F.col("fraction"))
    left = lambda c: (F.col(c) - F.floor(F.col(c) * F.col("share"))).cast("bigint")
    on = met.select(F.expr("place div 2").alias("request"), (F.col("place") % 2).alias("stop"), "key", share.alias("share"), "len_mm", "ms").select("request", "stop", "key", "share", left("len_mm").alias("mm"), left("ms").alias("ms"))
    on = graph._cut(on, "route-ends")
    firsts = on.where("stop = 0").select("request", "key", F.col("mm").alias("dist_mm"), "ms")
    goals = on.where("stop = 1").select("request", F.lit("end").alias("target"), "key", F.col("mm").alias("back_mm"), F.col("ms").alias("back_ms"))
    turns = graph.adjacency(keys, forbidden, stop).join(keys.select(F.col("key").alias("next_key"), F.col("ms").alias("next_ms")), "next_key")
    found = search.target_search(*search.from_places(firsts, turns, goals), step_mm=0, tiers=1, ways=True, local=True, **far).targets
    made = found.select("request", "dist_mm", "ms", F.transform("keys", search.original).alias("keys"))
    first, last = (on.where(f"stop = {k}").select("request", F.col("key").alias(c), F.col("share").alias(f"{c}_share")) for k, c in ((0, "first"), (1, "last")))
    made = made.withColumn("first", F.element_at("keys", 1)).withColumn("last", F.element_at("keys", -1)).join(first, ["request", "first"]).join(last, ["request", "last"])
    usable = on.groupBy("request").agg(F.count_distinct("stop").alias("n")).where("n = 2").select("request", F.lit(True).alias("usable"))
    both = requests.select("request").join(usable, "request", "left").join(made, "request", "left")
    outcome = F.when(F.col("usable").isNull(), "INVALID").when(F.col("keys").isNull(), "NO_ROUTE").otherwise("ROUTE")
    return both.select("request", outcome.alias("outcome"), "dist_mm", "ms", "keys", "first_share", "last_share")


def response_violations(responses: DataFrame) -> DataFrame:
    """(response_id, violation): the first rule that a response's shape breaks.

    responses: response_id, mode, has_inside, has_reference, has_handover, clearance, radius, n_points. A purely external route has
    no inside leg, reference or handover; others have an inside leg; crossing ones a handover whose search radius follows from
    its clearance, internal ones none; a line has two points at least.
    """
    crossing = F.col("mode").isin("OUTBOUND", "INBOUND")
    rule = (
        F.when(~F.col("mode").isin("INTERNAL", "EXTERNAL_ONLY") & ~crossing, "unknown mode")
        .when((F.col("mode") == "EXTERNAL_ONLY") & F.col("has_inside"), "external route with an inside leg")
        .when((F.col("mode") == "EXTERNAL_ONLY") & F.col("has_reference"), "external route with a reference")
        .when((F.col("mode") != "EXTERNAL_ONLY") & ~F.col("has_inside"), "no inside leg")
        .when(crossing & ~F.col("has_handover"), "no handover")
        .when(~crossing & F.col("has_handover"), "handover without a crossing")
        .when(crossing & (F.col("radius") != geo.poi_radius(F.col("clearance"), F.lit(False))), "radius does not follow from the clearance")
        .when(F.col("n_points") < 2, "line too short")
    )
    return responses.select("response_id", rule.alias("violation")).where("violation is not null")
