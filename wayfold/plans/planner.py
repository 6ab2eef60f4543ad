"""Plans by mode: routes on one side of an area's boundary, and routes that cross it by a release point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import graph, ordered, search, spatial
from wayfold.operators.topology import planning_mode
from wayfold.plans.build import plan_place_routes

# The step of distance tiers, their number, and the greatest angle between the ways to a release point and to the goal.
TIER_MM, TIERS, ANGLE = 1_000_000, 5, 60.0


def modes(requests: DataFrame, area: DataFrame) -> DataFrame:
    """(request, mode) by the sides of the area (ring segments) on which start and stop (struct<lng, lat>) lie."""
    ends = requests.select("request", F.explode(F.array(F.struct(F.lit("a").alias("e"), F.col("start").alias("at")), F.struct(F.lit("b").alias("e"), F.col("stop").alias("at")))).alias("x"))
    placed = spatial.locate(ends.select("request", "x.e", "x.at.lng", "x.at.lat"), area, ["request", "e"])
    sides = placed.groupBy("request").agg(*(F.max(F.when(F.col("e") == e, F.col("location"))).alias(e) for e in "ab"))
    return sides.select("request", planning_mode(F.col("a"), F.col("b")).alias("mode"))


def _score(inside: Column, outside: Column, lng: Column, lat: Column) -> Column:
    """Degrees between the ways from the inner place to a release point and to the outer place."""
    goal = geo.bearing(inside["lng"], inside["lat"], outside["lng"], outside["lat"])
    return F.round(geo.bearing_delta(geo.bearing(inside["lng"], inside["lat"], lng, lat), goal), 6)


def crossing_legs(requests: DataFrame, outbound: bool, edges: DataFrame, keys: DataFrame, forbidden: DataFrame, blocked: DataFrame, controlled: DataFrame, releases: DataFrame, most: float | None = None, accept: float = ANGLE, **far) -> DataFrame:
    """(request, outcome, target, tier, dist_mm, ms, keys, first_share, last_share): legs between an inner place and a release point.

    requests: request, start, stop; edges and keys as of plan_place_routes(); controlled: edge_id, the edges that may be driven
    wholly on the inner side; releases: target, key, fraction, lng, lat, points on directed keys where the boundary may be crossed.
    Outbound legs go from the start to a point, inbound ones, searched against the direction of travel, from a point to the stop.
    A key with a release point is driven up to it, or from it, only. Search goes on tier by tier until a point lies within `accept`
    degrees of the goal's direction, else the best of all is taken: by angle, then distance, then name.
    """
    inner, outer = ("start", "stop") if outbound else ("stop", "start")
    places = requests.select(F.col("request").alias("place"), F.col(inner)["lng"].alias("lng"), F.col(inner)["lat"].alias("lat"))
    snaps = graph._cut(spatial.snapped(places, edges, "place", most), "leg-places")
    open_keys = keys.join(blocked.select("edge_id"), "edge_id", "left_anti")
    free = graph._cut(open_keys.join(controlled.select("edge_id").distinct(), "edge_id", "left_semi"), "leg-keys")
    points = graph._cut(releases.join(open_keys.select("key", "len_mm", "ms"), "key"), "leg-points")
    part = lambda c, share: F.floor(F.col(c) * share).cast("bigint")
    share = F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, 1 - F.col("fraction")).otherwise(F.col("fraction"))
    on = snaps.where("valid").join(free, "edge_id").select(F.col("place").alias("request"), "key", share.alias("share"), "len_mm", "ms")
    on = graph._cut(on, "leg-ends")
    stop = blocked.select(F.explode(F.array(2 * F.col("edge_id"), 2 * F.col("edge_id") + 1)).alias("key"))
    turns = graph.adjacency(keys, forbidden, stop)
    cost = keys.select(F.col("key"), F.col("len_mm").alias("mm"), F.col("ms").alias("t"))
    if outbound:
        firsts = on.select("request", "key", (F.col("len_mm") - part("len_mm", F.col("share"))).alias("dist_mm"), (F.col("ms") - part("ms", F.col("share"))).alias("ms"))
        goals = points.select("target", "key", (F.col("len_mm") - part("len_mm", F.col("fraction"))).alias("back_mm"), (F.col("ms") - part("ms", F.col("fraction"))).alias("back_ms"))
        steps = turns.select("key", "next_key")
    else:
        firsts = on.select("request", "key", part("len_mm", F.col("share")).alias("dist_mm"), part("ms", F.col("share")).alias("ms"))
        goals = points.select("target", "key", part("len_mm", F.col("fraction")).alias("back_mm"), part("ms", F.col("fraction")).alias("back_ms"))
        steps = turns.select(F.col("next_key").alias("key"), F.col("key").alias("next_key"))
    # on from keys that are free, onto these and onto those with a release point, which end there
    onto = free.select(F.col("key").alias("next_key")).unionByName(points.select(F.col("key").alias("next_key"))).distinct()
    steps = steps.join(free.select("key"), "key", "left_semi").join(onto, "next_key", "left_semi")
    steps = steps.join(cost.withColumnsRenamed({"key": "next_key", "mm": "next_mm", "t": "next_ms"}), "next_key")
    # every request with every release point: a stated set of requests against all points
    pairs = requests.select("request", F.col(inner).alias("i"), F.col(outer).alias("o")).join(releases.select("target", "lng", "lat").dropDuplicates(["target"]))
    scores = graph._cut(pairs.select("request", "target", _score(F.col("i"), F.col("o"), F.col("lng"), F.col("lat")).alias("score")), "leg-scores")
    overlay = search.from_places(firsts, steps, goals)
    found = search.target_search(*overlay, step_mm=TIER_MM, tiers=TIERS, accepted=scores.where(F.col("score") <= accept).select("request", "target"), ways=True, **far).targets
    found = graph._cut(found, "leg-targets")
    best = ordered.tier_choice(found.select("request", "target", "dist_mm", "tier").join(scores, ["request", "target"]), accept)
    made = found.join(best.select("request", "target"), ["request", "target"])
    way = F.transform("keys", search.original)
    made = made.select("request", "target", "tier", "dist_mm", "ms", (way if outbound else F.reverse(way)).alias("keys"))
    at_place = F.element_at("keys", 1 if outbound else -1)
    at_point = F.element_at("keys", -1 if outbound else 1)
    own = on.select("request", F.col("key").alias("place_key"), F.col("share").alias("place_share"))
    spot = points.select("target", F.col("key").alias("point_key"), F.col("fraction").alias("point_share"))
    made = made.withColumns({"place_key": at_place, "point_key": at_point}).join(own, ["request", "place_key"]).join(spot, ["target", "point_key"])
    first, last = ("place_share", "point_share") if outbound else ("point_share", "place_share")
    both = requests.select("request").join(on.select("request").distinct().withColumn("usable", F.lit(True)), "request", "left").join(made, "request", "left")
    outcome = F.when(F.col("usable").isNull(), "INVALID").when(F.col("target").isNull(), "NO_ROUTE").otherwise("ROUTE")
    return both.select("request", outcome.alias("outcome"), "target", "tier", "dist_mm", "ms", "keys", F.col(first).alias("first_share"), F.col(last).alias("last_share"))


def plan(requests: DataFrame, area: DataFrame, edges: DataFrame, keys: DataFrame, forbidden: DataFrame, blocked: DataFrame, controlled: DataFrame, releases: DataFrame, most: float | None = None, **far) -> DataFrame:
    """(request, mode, outcome, target, tier, dist_mm, ms, keys, first_share, last_share) of a batch of requests of any modes.

    Requests on one side are routed from place to place. One that crosses the boundary has a leg on the inner side, to or from the
    release point that crossing_legs() chooses (releases with `direction`, OUT or IN); its outer side is handed over, as the walk
    from that point says (corridors.outward_walks). A place on the boundary is AMBIGUOUS, for the mode and the outcome.
    """
    known = graph._cut(requests.join(modes(requests, area), "request"), "plan-modes")
    same = plan_place_routes(known.where("mode in ('INTERNAL', 'EXTERNAL')").select("request", "start", "stop"), edges, keys, forbidden, blocked, most, **far)
    none = same.select("request", "outcome", F.lit(None).cast("string").alias("target"), F.lit(None).cast("int").alias("tier"), "dist_mm", "ms", "keys", "first_share", "last_share")
    for mode, direction in (("OUTBOUND", "OUT"), ("INBOUND", "IN")):
        legs = crossing_legs(known.where(F.col("mode") == mode).select("request", "start", "stop"), mode == "OUTBOUND", edges, keys, forbidden, blocked, controlled, releases.where(F.col("direction") == direction), most, **far)
        none = none.unionByName(legs)
    planned = known.select("request", "mode").join(none, "request", "left")
    return planned.withColumn("outcome", F.coalesce("outcome", F.lit("AMBIGUOUS")))
