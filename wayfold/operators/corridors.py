"""Corridors over a road network: outside distances, toll entries, interchanges, outward walks, split edges, assembled routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import graph, spatial

# Bounds of corridor and interchange searches, reach and step of an outward walk, and its wanted clearance.
CORRIDOR_MM, INTERCHANGE_MM = 5_000_000, 3_000_000
WALK_METRES, STEP_METRES, CLEAR_METRES = 500.0, 20.0, 250.0


def outside_distances(links: DataFrame, outside: DataFrame) -> DataFrame:
    """(node, dist_mm): from each node of the links (u, v, len_mm) the least way over them to a node of `outside`, if any."""
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    seeds = nodes.join(outside.select("node").distinct(), "node", "left_semi").select(F.lit(0).alias("request"), "node")
    spaced = links.withColumn("len_mm", F.greatest("len_mm", F.lit(1)))
    return graph.node_reach(seeds, spaced, (1 << 62)).select("node", "dist_mm")


def exit_keys(links: DataFrame, distances: DataFrame) -> DataFrame:
    """(edge_id, key): the direction of each link (edge_id, u, v) that leads to the smaller outside distance."""
    at = lambda c: distances.select(F.col("node").alias(c), F.col("dist_mm").alias(f"{c}_mm"))
    met = links.join(at("u"), "u", "left").join(at("v"), "v", "left")
    far = F.lit((1 << 63) - 1)
    a, b = F.coalesce("u_mm", far), F.coalesce("v_mm", far)
    return met.select("edge_id", F.when(b < a, 2 * F.col("edge_id")).when(a < b, 2 * F.col("edge_id") + 1).alias("key")).where("key is not null")


def corridor_paths(starts: DataFrame, keys: DataFrame, forbidden: DataFrame, reverse: bool = False, limit: int = CORRIDOR_MM) -> DataFrame:
    """(request, key, dist_mm, ms, pred): least ways from start nodes (request, node) over directed keys, of `limit` millimetres or less.

    keys: key, edge_id, from_node, to_node, len_mm, barrier; keys with `barrier` are reached, not passed, and cost nothing: their
    distance is that of the way before them. `reverse` searches against the direction of travel, where a turn ban still holds
    from the edge driven first.
    """
    a, b = ("to_node", "from_node") if reverse else ("from_node", "to_node")
    k = keys.select("key", "edge_id", F.col(a).alias("tail"), F.col(b).alias("head"), F.when(F.col("barrier"), 0).otherwise(F.col("len_mm")).alias("cost"), "barrier")
    first = k.where("not barrier").select("key", F.col("edge_id").alias("e1"), F.col("head").alias("via_node"))
    then = k.select(F.col("key").alias("next_key"), F.col("edge_id").alias("e2"), F.col("tail").alias("via_node"), F.col("cost").alias("next_mm"))
    ban = forbidden.select(F.col("to_edge" if reverse else "from_edge").alias("e1"), "via_node", F.col("from_edge" if reverse else "to_edge").alias("e2"))
    turns = first.join(then, "via_node").join(ban, ["e1", "via_node", "e2"], "left_anti").select("key", "next_key", "next_mm")
    seeds = starts.withColumnRenamed("node", "tail").join(k, "tail").select("request", "key", F.col("cost").alias("dist_mm"))
    return graph.shortest_paths(seeds, turns, limit)


def corridor_searches(starts: DataFrame, keys: DataFrame, forbidden: DataFrame, reverse: bool = False, limit: int = CORRIDOR_MM) -> DataFrame:
    """(request, key, dist_mm) of corridor_paths()."""
    return corridor_paths(starts, keys, forbidden, reverse, limit).select("request", "key", "dist_mm")


def toll_corridor_keys(booths: DataFrame, keys: DataFrame, forbidden: DataFrame, outside: DataFrame) -> DataFrame:
    """(role, key): the union of all directed keys on ways of each role: ENTRY, from a booth to each ring mainline key that it leads to,
    and EXIT, from outside to a booth by its least way (of equal ones by the smaller key). Mainline keys themselves belong to none."""
    own = keys.where("not barrier")
    entry = graph._cut(corridor_paths(booths, keys, forbidden), "entry-paths")
    rings = entry.join(keys.where("ring").select("key"), "key", "left_semi").select("request", "key")
    exits = graph._cut(corridor_paths(booths, keys, forbidden, reverse=True), "exit-paths")
    out = own.join(outside.select(F.col("node").alias("from_node")), "from_node", "left_semi").select("key")
    least = exits.join(out, "key", "left_semi").groupBy("request").agg(F.min(F.struct("dist_mm", "key")).alias("b")).select("request", "b.key")
    each = [graph.traced(paths, ends).select(F.lit(role).alias("role"), "key") for role, paths, ends in (("ENTRY", entry, rings), ("EXIT", exits, least))]
    return each[0].unionByName(each[1]).distinct().join(own.select("key"), "key", "left_semi").select("role", "key")


def toll_entries(booths: DataFrame, keys: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(request, key, dist_mm): ring mainline keys that each booth (request, node) leads to. keys carry `ring` and `barrier`."""
    found = corridor_searches(booths, keys, forbidden)
    return found.join(keys.where("ring").select("key"), "key", "left_semi")


def toll_exits(booths: DataFrame, keys: DataFrame, forbidden: DataFrame, outside: DataFrame) -> DataFrame:
    """(request, dist_mm): the least way, against the direction of travel, from each booth to a node outside; 0 for one there."""
    found = corridor_searches(booths, keys, forbidden, reverse=True).join(keys.where("not barrier").select("key", F.col("from_node").alias("node")), "key")
    reached = found.join(outside.select("node"), "node", "left_semi").select("request", "dist_mm")
    there = booths.join(outside.select("node"), "node", "left_semi").select("request", F.lit(0).cast("bigint").alias("dist_mm"))
    return reached.unionByName(there).groupBy("request").agg(F.min("dist_mm").alias("dist_mm"))


def toll_audit(source: DataFrame, booths: DataFrame, entries: DataFrame, exits: DataFrame) -> DataFrame:
    """One row: facilities, mapped ones, those with an entry, with an exit, with either, and with only one of both."""
    has = lambda df, c: df.select("request").distinct().withColumn(c, F.lit(True))
    met = booths.select("request").distinct().join(has(entries, "entry"), "request", "left").join(has(exits, "exit"), "request", "left")
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0)).cast("bigint")
    a, b = F.coalesce("entry", F.lit(False)), F.coalesce("exit", F.lit(False))
    counts = met.agg(F.count("*").alias("mapped"), n(a).alias("entry"), n(b).alias("exit"), n(a | b).alias("related"), n(a != b).alias("unresolved"))
    return source.agg(F.count("*").alias("source")).join(counts)


def interchange_chains(links: DataFrame, mains: DataFrame, forbidden: DataFrame, limit: int = INTERCHANGE_MM) -> DataFrame:
    """(start_key, from_edge, keys, nodes, end_key, to_edge, dist_mm): legal drives from one mainline edge over links to another.

    links and mains: key, edge_id, from_node, to_node (links len_mm too), the directed keys that may be driven. A drive arrives on
    a mainline key, turns onto a link, goes on over links without meeting a node twice, at most `limit` millimetres of them, and
    turns onto another mainline edge; no turn of it (edge, node, edge) is in `forbidden`. Grown hop by hop as joins, from all
    mainline keys at once, until no drive grows.
    """
    ban = lambda df, first, node, then: df.join(forbidden.select(F.col("from_edge").alias(first), F.col("via_node").alias(node), F.col("to_edge").alias(then)), [first, node, then], "left_anti")
    steps = links.select("key", F.col("edge_id").alias("link"), F.col("from_node").alias("node"), "to_node", "len_mm")
    ends = mains.select(F.col("key").alias("end_key"), F.col("edge_id").alias("to_edge"), F.col("from_node").alias("node"))
    grown = mains.select(F.col("key").alias("start_key"), F.col("edge_id").alias("from_edge"), F.col("edge_id").alias("last"), F.col("to_node").alias("node"), F.array().cast("array<bigint>").alias("keys"), F.array("to_node").alias("nodes"), F.lit(0).cast("bigint").alias("dist_mm"))
    found = None
    while True:
        step = grown.join(steps, "node").where(~F.array_contains("nodes", F.col("to_node")) & (F.col("dist_mm") + F.col("len_mm") <= limit))
        step = ban(step, "last", "node", "link")
        grown = graph._cut(step.select("start_key", "from_edge", F.col("link").alias("last"), F.col("to_node").alias("node"), F.concat("keys", F.array("key")).alias("keys"), F.concat("nodes", F.array("to_node")).alias("nodes"), (F.col("dist_mm") + F.col("len_mm")).alias("dist_mm")), "interchange-drives")
        met = ban(grown.join(ends, "node").where("to_edge <> from_edge"), "last", "node", "to_edge")
        met = met.select("start_key", "from_edge", "keys", "nodes", "end_key", "to_edge", "dist_mm")
        found = met if found is None else found.unionByName(met)
        if grown.isEmpty():
            return found


def interchanges(chains: DataFrame, excluded_nodes: DataFrame, excluded_keys: DataFrame | None = None) -> DataFrame:
    """chains with `excluded`: NODE if a drive meets a node of excluded_nodes, else KEY if it uses one of excluded_keys (key), else null."""
    own = ["start_key", "keys", "end_key"]
    bad = chains.select(*own, F.explode("nodes").alias("node")).join(excluded_nodes.select("node").distinct(), "node", "left_semi").select(*own, F.lit(0).alias("why"))
    if excluded_keys is not None:
        bad = bad.unionByName(chains.select(*own, F.explode("keys").alias("key")).join(excluded_keys.select("key").distinct(), "key", "left_semi").select(*own, F.lit(1).alias("why")))
    why = bad.groupBy(*own).agg(F.min("why").alias("why"))
    return chains.join(why, own, "left").withColumn("excluded", F.when(F.col("why") == 0, "NODE").when(F.col("why") == 1, "KEY")).drop("why")


def interchange_audit(labelled: DataFrame, links: DataFrame, mains: DataFrame) -> DataFrame:
    """One row: components of links, those that touch a mainline edge, those that touch two (candidates), candidates without any
    drive (unresolved), drives found, excluded by node and by key, kept, pairs of edges kept, and the longest kept.

    labelled: drives as interchanges() returns them; links: u, v; mains: edge_id, node (each node of a mainline edge)."""
    parts = graph._cut(graph.components(links.select(F.col("u").alias("a"), F.col("v").alias("b"))), "link-parts")
    touch = parts.join(mains.select("node", "edge_id").distinct(), "node").groupBy("component").agg(F.count_distinct("edge_id").alias("mains"))
    solved = labelled.select(F.element_at("nodes", 1).alias("node")).distinct().join(parts, "node").select("component").distinct().withColumn("solved", F.lit(True))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False))).cast("bigint")
    each = parts.select("component").distinct().join(touch, "component", "left").join(solved, "component", "left")
    some = each.agg(F.count("*").alias("components"), n(F.col("mains") >= 1).alias("touching"), n(F.col("mains") >= 2).alias("candidates"), n((F.col("mains") >= 2) & F.col("solved").isNull()).alias("unresolved"))
    kept = F.col("excluded").isNull()
    pair = F.when(kept, F.struct(F.least("from_edge", "to_edge"), F.greatest("from_edge", "to_edge")))
    counts = labelled.agg(F.count("*").alias("drives"), n(F.col("excluded") == "NODE").alias("excluded_nodes"), n(F.col("excluded") == "KEY").alias("excluded_keys"), n(kept).alias("kept"), F.count_distinct(pair).alias("pairs"), F.coalesce(F.max(F.when(kept, F.col("dist_mm"))), F.lit(0)).alias("longest_mm"))
    return some.join(counts)


def outward_walks(starts: DataFrame, edges: DataFrame, points: DataFrame) -> DataFrame:
    """(portal_id, hop, edge_id, k, along_m, clearance): where each walk from a crossing hands over.

    starts: portal_id, edge_id, lng, lat, node (the edge's outer end); edges: edge_id, u, v and their places, only those that may be
    walked. Edges are walked in both directions, those that a walk has not met before, hop by hop, up to WALK_METRES from the
    crossing, with a place every STEP_METRES. Of the places the first (by hops, then edge, then place) that is CLEAR_METRES from
    every point is taken, else the clearest, then the first.
    """
    ways = edges.select("edge_id", F.col("u").alias("a"), F.col("v").alias("b"), F.col("ulng").alias("ax"), F.col("ulat").alias("ay"), F.col("vlng").alias("bx"), F.col("vlat").alias("by"))
    ways = ways.unionByName(edges.select("edge_id", F.col("v").alias("a"), F.col("u").alias("b"), F.col("vlng").alias("ax"), F.col("vlat").alias("ay"), F.col("ulng").alias("bx"), F.col("ulat").alias("by")))
    place = starts.join(ways.select(F.col("edge_id"), F.col("b").alias("node"), "bx", "by"), ["edge_id", "node"])
    metres = geo.haversine(*map(F.col, ("ax", "ay", "bx", "by")))
    walk = place.select("portal_id", F.lit(0).alias("hop"), "edge_id", F.col("lng").alias("ax"), F.col("lat").alias("ay"), "bx", "by", F.col("node").alias("b"), F.lit(0.0).alias("from_m")).withColumn("metres", metres)
    walk = graph._cut(walk, "walk")
    seen, hop = walk, 0
    while True:
        hop += 1
        going = walk.where(F.col("from_m") + F.col("metres") < WALK_METRES).select("portal_id", F.col("b").alias("a"), (F.col("from_m") + F.col("metres")).alias("from_m"))
        step = going.join(ways, "a").join(seen.select("portal_id", "edge_id"), ["portal_id", "edge_id"], "left_anti").withColumn("metres", metres)
        step = step.groupBy("portal_id", "edge_id").agg(F.min_by(F.struct("ax", "ay", "bx", "by", "b", "from_m", "metres"), F.struct("from_m", "a")).alias("s"))
        walk = graph._cut(step.select("portal_id", F.lit(hop).alias("hop"), "edge_id", "s.ax", "s.ay", "s.bx", "s.by", "s.b", "s.from_m", "s.metres"), "walk")
        if walk.isEmpty():
            break
        seen = seen.unionByName(walk)
    n = F.greatest(F.lit(1), F.ceil(F.least("metres", F.lit(WALK_METRES) - F.col("from_m")) / STEP_METRES)).cast("int")
    spots = seen.withColumn("k", F.explode(F.sequence(F.lit(1), n)))
    t = F.least(F.lit(1.0), F.col("k") * STEP_METRES / F.greatest("metres", F.lit(0.001)))
    along = F.col("from_m") + F.least("metres", F.col("k") * STEP_METRES)
    spots = spots.select("portal_id", "hop", "edge_id", "k", along.alias("along_m"), geo.interpolate(F.col("ax"), F.col("bx"), t).alias("lng"), geo.interpolate(F.col("ay"), F.col("by"), t).alias("lat")).where(F.col("along_m") <= WALK_METRES)
    near = spatial.points_within(points.select("point_id", F.col("lng"), F.col("lat")), spots, CLEAR_METRES).groupBy("portal_id", "edge_id", "k").agg(F.min("dist_m").alias("near_m"))
    clear = spots.join(near, ["portal_id", "edge_id", "k"], "left").withColumn("clearance", F.coalesce(F.round("near_m", 4), F.lit(CLEAR_METRES)))
    best = clear.groupBy("portal_id").agg(F.min(F.struct((-F.col("clearance")).alias("c"), "hop", "edge_id", "k", "along_m")).alias("b"))
    return best.select("portal_id", "b.hop", "b.edge_id", "b.k", "b.along_m", (-F.col("b.c")).alias("clearance"))


def split_edges(snapped: DataFrame, keys: DataFrame) -> DataFrame:
    """(point_id, orig_key, part, from_node, to_node, len_mm): both parts of every directed key of the edge that a point was
    snapped to (point_id, edge_id, fraction); the split's own node is -1 - point_id, and each part keeps the key it comes from."""
    met = snapped.join(keys, "edge_id")
    share = F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, 1 - F.col("fraction")).otherwise(F.col("fraction"))
    first = F.floor(F.col("len_mm") * share).cast("bigint")
    node = -1 - F.col("point_id")
    parts = F.array(F.struct(F.lit(1).alias("part"), F.col("from_node"), node.alias("to_node"), first.alias("len_mm")), F.struct(F.lit(2).alias("part"), node.alias("from_node"), F.col("to_node"), (F.col("len_mm") - first).alias("len_mm")))
    return met.select("point_id", F.col("key").alias("orig_key"), F.explode(parts).alias("p")).select("point_id", "orig_key", "p.*")


def assembled(routes: DataFrame, keys: DataFrame, edges: DataFrame) -> DataFrame:
    """(request, points, trace, dist_mm, ms, continuous) of routes (request, keys array): the line without repeated places, a
    trace of (seq, key), totals, and whether each key starts where the one before ends.

    keys: key, edge_id, from_node, to_node, len_mm, ms; edges: edge_id and the places of u and v. With columns first_share and
    last_share a route begins and ends at these shares of its first and last key; lengths and times of their parts are cut down to
    whole units from the key's start. An edge driven in part has its part of the line, of the length and of the time.
    """
    for c, whole in (("first_share", 0.0), ("last_share", 1.0)):
        if c not in routes.columns:
            routes = routes.withColumn(c, F.lit(whole))
    steps = routes.select("request", "first_share", "last_share", F.size("keys").alias("n"), F.posexplode("keys").alias("seq", "key")).join(keys, "key").join(edges.select("edge_id", "ulng", "ulat", "vlng", "vlat"), "edge_id")
    since = F.when(F.col("seq") == 0, F.col("first_share")).otherwise(0.0)
    until = F.when(F.col("seq") == F.col("n") - 1, F.col("last_share")).otherwise(1.0)
    back = F.col("key").bitwiseAND(F.lit(1)) == 1
    along = lambda a, b, t: geo.interpolate(F.when(back, F.col(b)).otherwise(F.col(a)), F.when(back, F.col(a)).otherwise(F.col(b)), t)
    spot = lambda t: F.struct(along("ulng", "vlng", t).alias("lng"), along("ulat", "vlat", t).alias("lat"))
    part = lambda c: (F.floor(F.col(c) * until) - F.floor(F.col(c) * since)).cast("bigint")
    w = Window.partitionBy("request").orderBy("seq")
    steps = steps.withColumn("start", spot(since)).withColumn("stop", spot(until)).withColumn("follows", F.coalesce(F.lag("to_node").over(w) == F.col("from_node"), F.lit(True)))
    found = steps.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("seq", "key", "start", "stop"))).alias("s"), F.sum(part("len_mm")).alias("dist_mm"), F.sum(part("ms")).alias("ms"), F.bool_and("follows").alias("continuous"))
    points = F.concat(F.slice(F.transform("s", lambda x: x["start"]), 1, 1), F.transform("s", lambda x: x["stop"]))
    return found.select("request", points.alias("points"), F.transform("s", lambda x: F.struct(x["seq"].alias("seq"), x["key"].alias("key"))).alias("trace"), "dist_mm", "ms", "continuous")


def uses_blocked(routes: DataFrame, blocked: DataFrame) -> DataFrame:
    """(request, key): keys of finished routes (request, keys) on blocked edges (edge_id); a sound search leaves none."""
    steps = routes.select("request", F.explode("keys").alias("key"))
    return steps.join(blocked.select("edge_id"), F.shiftright("key", 1) == F.col("edge_id"), "left_semi").select("request", "key")


def link_chains(runs: DataFrame) -> DataFrame:
    """(route_id, first_run, last_run, prev_key, next_key): maximal stretches of link runs, with the runs around them.

    runs: route_id, run, edge_key, is_link.
    """
    w = Window.partitionBy("route_id").orderBy("run")
    marked = runs.withColumn("prev_key", F.lag("edge_key").over(w)).withColumn("next_key", F.lead("edge_key").over(w))
    marked = marked.withColumn("new", F.when(F.col("is_link") & ~F.coalesce(F.lag("is_link").over(w), F.lit(False)), 1).otherwise(0))
    chain = marked.withColumn("chain", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("is_link")
    return chain.groupBy("route_id", "chain").agg(F.min("run").alias("first_run"), F.max("run").alias("last_run"), F.min_by("prev_key", "run").alias("prev_key"), F.max_by("next_key", "run").alias("next_key")).drop("chain")


def turn_costs(keys: DataFrame, forbidden: DataFrame, entry_penalty: int = 1_000_000_000) -> DataFrame:
    """(key, next_key, seconds): turns of the driving profile. keys: key, edge_id, from_node, to_node, open. Turns back and
    banned ones are left out; to enter a restricted stretch from an open one costs `entry_penalty` seconds."""
    a = keys.select("key", F.col("edge_id").alias("from_edge"), F.col("to_node").alias("via_node"), F.col("open").alias("was_open"))
    b = keys.select(F.col("key").alias("next_key"), F.col("edge_id").alias("to_edge"), F.col("from_node").alias("via_node"), "open")
    met = a.join(b, "via_node").where("from_edge <> to_edge").join(forbidden, ["from_edge", "via_node", "to_edge"], "left_anti")
    return met.select("key", "next_key", F.when(F.col("was_open") & ~F.col("open"), entry_penalty).otherwise(0).cast("bigint").alias("seconds"))


def restricted_ends(ends: DataFrame, points: DataFrame, edges: DataFrame, metres: float, key: str) -> DataFrame:
    """ends (key, lng, lat) with `restricted`: a point lies within `metres`, unless the nearest edge is exempt. Ends that snap to
    no edge are not restricted. edges: edge_id, places, exempt."""
    # ends of a network lie on its edges: the first ring is a narrow one
    snapped = spatial.nearest_edge(ends, edges.select("edge_id", "ulng", "ulat", "vlng", "vlat"), key, first=metres).join(edges.select("edge_id", "exempt"), "edge_id", "left")
    near = spatial.points_within(points.select("lng", "lat"), ends.select(key, "lng", "lat"), metres).select(key).distinct().withColumn("near", F.lit(True))
    met = snapped.join(near, key, "left")
    return met.select(*ends.columns, (F.coalesce("near", F.lit(False)) & F.col("edge_id").isNotNull() & ~F.coalesce("exempt", F.lit(False))).alias("restricted"))
