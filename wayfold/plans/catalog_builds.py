"""More queries over a folder of tables: areas, corridors, assembled routes, texts. oracle_builds.py has their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo, polyline, text
from wayfold.operators import areas, corridors, graph, ordered, polygons, search, spatial
from wayfold.plans import build, planner
from wayfold.plans.catalog import QUERIES as QUERIES
from wayfold.plans.catalog import RADIUS, blocked, classified, exits, legal_turns, portals, query, r, scored, seeds
from wayfold.sources.fixtures import Network

#: One side of the outer ring stands for the border line.
BORDER = ("ring = 0 and seq = 1", 60.0)


def metres_a_second(road_class: Column) -> Column:
    return F.when(road_class == "motorway", 25).when(road_class == "motorway_link", 12).when(road_class == "primary", 15).otherwise(8)


def timed_keys(net: Network) -> DataFrame:
    kinds = net.edges.select("edge_id", metres_a_second(F.col("road_class")).alias("mps"))
    return net.edge_keys.join(kinds, "edge_id").withColumn("ms", F.expr("len_mm div mps")).drop("mps")


def intervals(net: Network) -> DataFrame:
    return areas.side_intervals(net.edges, net.ring_segments)


def side_portals(net: Network) -> DataFrame:
    return areas.directed_portals(intervals(net), net.edge_keys)


@query
def edge_costs(net: Network) -> DataFrame:
    ms, metres = F.expr("len_mm div mps"), F.col("len_mm") / 1000
    e = net.edges.withColumn("mps", metres_a_second(F.col("road_class")))
    return e.select("edge_id", F.when(F.col("car_access"), ms / 1000.0).alias("time_cost"), F.when(F.col("car_access"), metres).alias("distance_cost"), F.greatest(F.lit(0), F.expr("len_mm div mps div 1000")).alias("seconds"), F.round(metres / 16.67 * 1000).cast("bigint").alias("handover_ms"), text.edge_of(2 * F.col("edge_id") + 1).alias("base"))


@query
def timed_paths(net: Network) -> DataFrame:
    """Distance first, then time."""
    keys = timed_keys(net)
    turns = graph.adjacency(keys, net.forbidden_turns).join(keys.select(F.col("key").alias("next_key"), F.col("ms").alias("next_ms")), "next_key")
    starts = keys.where("from_node = 0").select(F.lit(0).alias("request"), "key", F.col("len_mm").alias("dist_mm"), "ms")
    return graph.shortest_paths(starts, turns).select("key", "dist_mm", "ms")


def place_requests(net: Network) -> DataFrame:
    """From a place by every node whose number 50 divides, two requests: to one by the node numbered 125 higher, and 425 higher."""
    at = lambda name, x, y: net.nodes.select(F.col("node").alias(f"{name}_node"), F.struct((F.col("lng") + x).alias("lng"), (F.col("lat") + y).alias("lat")).alias(name))
    a = at("start", 0.0037, 0.0006).where("start_node % 50 = 0").withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    met = a.join(at("stop", 0.0006, 0.0062), F.col("stop_node") == F.col("start_node") + F.when(F.col("v") == 0, 125).otherwise(425))
    return met.select((2 * F.col("start_node") + F.col("v")).alias("request"), "start", "stop")


def planning_tables(net: Network) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Blocked edges, edges and directed keys that cars may use, and banned turns: made once, as a plan reads each many times."""
    tables = blocked(net).select("edge_id"), net.edges.where("car_access"), timed_keys(net), net.forbidden_turns
    return tuple(graph._cut(x, "planning") for x in tables)


@query
def planned_routes(net: Network) -> DataFrame:
    """Assembled routes between places: outcome, totals of the search and of the line's parts, ends, continuity, blocked keys used."""
    stop, edges, keys, bans = planning_tables(net)
    routes = graph._cut(build.plan_place_routes(place_requests(net), edges, keys, bans, stop), "routes")
    made = corridors.assembled(routes.where("keys is not null"), keys, net.edges)
    bad = corridors.uses_blocked(routes.where("keys is not null"), stop).groupBy("request").agg(F.count("*").alias("n"))
    made = made.select("request", "points", "trace", "continuous", F.col("dist_mm").alias("line_mm"), F.col("ms").alias("line_ms"))
    ends = lambda i, c: r(F.element_at("points", i)[c], 6)
    met = routes.join(made, "request", "left").join(bad, "request", "left")
    sound = F.col("continuous") & (F.size("points") == F.size("trace") + 1) & (F.col("line_mm") == F.col("dist_mm")) & (F.col("line_ms") == F.col("ms")) & F.col("n").isNull()
    return met.select("request", "outcome", "dist_mm", "ms", sound.alias("sound"), ends(1, "lng").alias("start_lng"), ends(1, "lat").alias("start_lat"), ends(-1, "lng").alias("end_lng"), ends(-1, "lat").alias("end_lat"))


def release_targets(net: Network) -> DataFrame:
    """Directed crossings on ordinary roads: target, key, fraction, direction and place."""
    plain = net.edges.where("car_access and road_class <> 'motorway' and not is_link")
    met = side_portals(net).join(plain.select("edge_id", "ulng", "ulat", "vlng", "vlat"), "edge_id")
    t = F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, 1 - F.col("fraction")).otherwise(F.col("fraction"))
    name = F.concat_ws("-", F.lit("R"), "key", F.round(F.col("fraction") * 1e6).cast("bigint"))
    return met.select(name.alias("target"), "key", "direction", F.round("fraction", 9).alias("fraction"), geo.interpolate(F.col("ulng"), F.col("vlng"), t).alias("lng"), geo.interpolate(F.col("ulat"), F.col("vlat"), t).alias("lat"))


@query
def mode_plans(net: Network) -> DataFrame:
    """Requests between places of all modes: routes on one side, or legs between the inner place and the chosen release point."""
    stop, edges, keys, bans = planning_tables(net)
    flags = areas.area_flags(intervals(net))
    controlled = areas.controlled_edges(classified(net).where("car_access"), flags).where("controlled_ok").select("edge_id")
    found = planner.plan(place_requests(net), net.ring_segments, edges, keys, bans, stop, graph._cut(controlled, "controlled"), graph._cut(release_targets(net), "releases"))
    return found.select("request", "mode", "outcome", "target", "tier", "dist_mm", "ms")


@query
def snapped_points(net: Network) -> DataFrame:
    """Points on the nearest edge that cars may use, within 150 m."""
    found = spatial.snapped(net.points, net.edges.where("car_access"), "point_id", 150.0)
    return found.select("point_id", "edge_id", r("fraction", 7).alias("fraction"), r("on_lng", 7).alias("on_lng"), r("on_lat", 7).alias("on_lat"), r("dist_m", 4).alias("dist_m"), "valid")


@query
def restricted_endpoints(net: Network) -> DataFrame:
    ends = net.nodes.select("node", "lng", "lat")
    return corridors.restricted_ends(ends, net.points, classified(net), RADIUS, "node").select("node", "restricted")


@query
def area_constraints(net: Network) -> DataFrame:
    flags = areas.area_flags(intervals(net))
    return areas.controlled_edges(classified(net), flags).join(flags, "edge_id").select("edge_id", "stays_within", "avoids_interior", "controlled_ok")


def by_geometry(net: Network) -> DataFrame:
    return areas.classify_edges(net.tagged_edges, net.ring_segments, net.second_segments)


@query
def geometric_classes(net: Network) -> DataFrame:
    return by_geometry(net).select("edge_id", "in_inner", "in_second", "link", "mainline", "ring", "mismatch", "exempt", "forbidden", "second_main")


@query
def geometric_audit(net: Network) -> DataFrame:
    return areas.classification_counts(by_geometry(net))


@query
def released_phase(net: Network) -> DataFrame:
    flags = areas.area_flags(intervals(net))
    e = classified(net).join(flags, "edge_id")
    ok = areas.released_ok(F.col("zone") == "INNER", F.col("mainline"), F.col("is_link"), F.col("edge_id") % 11 == 0, F.lit(False), F.col("avoids_interior"))
    return e.select("edge_id", ok.alias("released_ok"))


@query
def edge_side_intervals(net: Network) -> DataFrame:
    return intervals(net).select("edge_id", F.col("k").cast("int").alias("k"), r("start", 7).alias("start"), r("stop", 7).alias("stop"), "side")


@query
def directed_portals(net: Network) -> DataFrame:
    return side_portals(net).select("key", "direction", "kind", r("fraction", 7).alias("fraction"))


@query
def portal_audit(net: Network) -> DataFrame:
    return areas.portal_audit(intervals(net), side_portals(net), net.edges)


@query
def border_release_points(net: Network) -> DataFrame:
    border = net.ring_segments.where(BORDER[0])
    edges = net.edges.select("edge_id", (F.col("road_class") == "motorway").alias("mainline"), "is_link")
    return areas.release_points(portals(net), edges, border, BORDER[1]).select("portal_id", "direction")


def outside_nodes(net: Network) -> DataFrame:
    return net.nodes.where("gx >= 30").select("node")


@query
def connector_exits(net: Network) -> DataFrame:
    links = net.edges.where("is_link")
    return corridors.exit_keys(links, corridors.outside_distances(links.select("u", "v", "len_mm"), outside_nodes(net)))


@query
def outer_walk_hops(net: Network) -> DataFrame:
    out = portals(net).where("direction = 'OUT'").join(net.edges.select("edge_id", F.col("v").alias("node")), "edge_id").select("portal_id", "edge_id", "lng", "lat", "node")
    may = classified(net).where("car_access and (zone <> 'INNER' or road_class <> 'motorway')")
    return corridors.outward_walks(out, may, net.points).select("portal_id", "hop", "edge_id", "k", r("along_m", 4).alias("along_m"), "clearance")


def toll_keys(net: Network) -> DataFrame:
    flags = classified(net).select("edge_id", "mainline", (F.col("mainline") & (F.col("zone") == "SECOND")).alias("ring"))
    return net.edge_keys.join(flags, "edge_id").withColumnRenamed("mainline", "barrier")


def booths(net: Network) -> DataFrame:
    return net.table("supplier").select(F.col("s_suppkey").alias("request"), (F.col("s_suppkey") * 7).alias("node")).join(net.nodes.select("node"), "node", "left_semi")


@query
def toll_entries(net: Network) -> DataFrame:
    return corridors.toll_entries(booths(net), toll_keys(net), net.forbidden_turns)


@query
def toll_exits(net: Network) -> DataFrame:
    return corridors.toll_exits(booths(net), toll_keys(net), net.forbidden_turns, outside_nodes(net))


@query
def toll_audit(net: Network) -> DataFrame:
    return corridors.toll_audit(net.table("supplier"), booths(net), toll_entries(net), toll_exits(net))


@query
def toll_corridor_keys(net: Network) -> DataFrame:
    return corridors.toll_corridor_keys(booths(net), toll_keys(net), net.forbidden_turns, outside_nodes(net))


def found_interchanges(net: Network) -> DataFrame:
    keys = net.edge_keys.join(classified(net).select("edge_id", "mainline", "is_link"), "edge_id")
    chains = corridors.interchange_chains(keys.where("is_link"), keys.where("mainline"), net.forbidden_turns)
    tolls = net.nodes.where("node % 7 = 0 and node % 5 = 0").select("node")
    return graph._cut(corridors.interchanges(chains, tolls, toll_corridor_keys(net)), "interchanges")


@query
def interchanges(net: Network) -> DataFrame:
    """Drives that meet no toll node, and whether they share a key with a toll corridor."""
    found = found_interchanges(net).where("excluded is null or excluded = 'KEY'")
    return found.select("from_edge", F.array_join(F.transform("nodes", lambda x: x.cast("string")), "-").alias("path"), "to_edge", "dist_mm", F.col("excluded").isNotNull().alias("toll_overlap"))


@query
def interchange_audit(net: Network) -> DataFrame:
    may = classified(net).where("car_access")
    mains = may.where("mainline").select("edge_id", F.explode(F.array("u", "v")).alias("node"))
    return corridors.interchange_audit(found_interchanges(net), may.where("is_link"), mains)


def chosen_cells(net: Network) -> DataFrame:
    """Squares of the grid by their sides: a node's square for each part of size 20 or more."""
    step = 0.01
    at = net.nodes.join(net.table("part").where("p_size >= 20").select(F.col("p_partkey").alias("node")), "node")
    corner = lambda i, j: F.struct((F.lit(116.0) + (F.col("gx") + i) * step).alias("x"), (F.lit(39.6) + (F.col("gy") + j) * step).alias("y"))
    sides = F.array(*(F.struct(corner(*a).alias("a"), corner(*b).alias("b")) for a, b in (((0, 0), (1, 0)), ((1, 0), (1, 1)), ((1, 1), (0, 1)), ((0, 1), (0, 0)))))
    return at.select(F.col("node").alias("part"), F.explode(sides).alias("s")).select("part", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


@query
def merged_border(net: Network) -> DataFrame:
    return polygons.union_border(chosen_cells(net))


@query
def merged_rings(net: Network) -> DataFrame:
    rings = graph._cut(polygons.rings_of(polygons.union_border(chosen_cells(net))), "merged-rings")
    first = rings.where("seq = 0").select("ring", r("lng", 6).alias("lng"), r("lat", 6).alias("lat"))
    return polygons.signed_areas(rings).join(first, "ring").select("lng", "lat", "points", r("area", 9).alias("area"))


@query
def split_edges(net: Network) -> DataFrame:
    near = spatial.nearest_edge(net.points, net.edges.select("edge_id", "ulng", "ulat", "vlng", "vlat"), "point_id").join(net.edges.select("edge_id", "ulng", "ulat", "vlng", "vlat"), "edge_id")
    at = near.select("point_id", "edge_id", r(geo.segment_fraction(*map(F.col, ("lng", "lat", "ulng", "ulat", "vlng", "vlat"))), 9).alias("fraction"))
    return corridors.split_edges(at, net.edge_keys)


@query
def link_chains(net: Network) -> DataFrame:
    runs = ordered.edge_runs(net.traces).withColumn("edge_id", F.shiftright("edge_key", 1)).hint("merge").join(net.edges.select("edge_id", "is_link"), "edge_id")
    return corridors.link_chains(runs)


@query
def turn_costs(net: Network) -> DataFrame:
    keys = net.edge_keys.join(net.edges.select("edge_id", (F.col("edge_id") % 19 != 3).alias("open")), "edge_id")
    return corridors.turn_costs(keys, net.forbidden_turns)


def looked_at(net: Network) -> DataFrame:
    """Turns of keys that aren't blocked, with those marked that a search must reject: 1 banned, 2 onto a blocked edge."""
    stop = blocked(net).select("edge_id")
    a = net.edge_keys.join(stop, "edge_id", "left_anti").select("key", F.col("edge_id").alias("from_edge"), F.col("to_node").alias("via_node"))
    b = net.edge_keys.select(F.col("key").alias("next_key"), F.col("edge_id").alias("to_edge"), F.col("from_node").alias("via_node"), F.col("len_mm").alias("next_mm"))
    met = a.join(b, "via_node").join(net.forbidden_turns.withColumn("banned", F.lit(True)), ["from_edge", "via_node", "to_edge"], "left").join(stop.select(F.col("edge_id").alias("to_edge"), F.lit(True).alias("blocked")), "to_edge", "left")
    return met.select("key", "next_key", "next_mm", F.when(F.col("banned"), 1).when(F.col("blocked"), 2).otherwise(0).alias("reject"))


@query
def search_audit(net: Network) -> DataFrame:
    """Of each search for exits: keys settled, turns looked at, those rejected as banned or as blocked, and how it ended."""
    return search.target_search(seeds(net), looked_at(net), exits(net)).audit


@query
def tier_choice(net: Network) -> DataFrame:
    """The best target of the first tier that has one within 60 degrees of the goal, else the best of all. A search goes on to the
    next tier only while it has met no such target."""
    pairs = seeds(net).select("request").distinct().join(exits(net).select("target").distinct())
    good = scored(net, pairs, exits(net)).where("score <= 60").select("request", "target")
    near = search.nearest_targets(seeds(net), legal_turns(net), exits(net), accepted=good)
    return ordered.tier_choice(scored(net, near, exits(net)), 60.0)


@query
def first_alternatives(net: Network) -> DataFrame:
    k = F.col("o_orderkey")
    routes = net.table("orders").select(F.col("o_custkey").alias("request"), k.alias("route"), F.floor(F.col("o_totalprice")).cast("bigint").alias("dist_m"))
    return ordered.first_of_each(routes, "request", ["dist_m", "route"], 3)


@query
def text_forms(net: Network) -> DataFrame:
    k = F.col("p_partkey")
    metres, seconds = k * 7.5, k * 31.0
    parts = F.array("p_brand", F.concat("p_brand", F.lit(" A")), F.lit("A"), F.col("p_type"))
    reason = F.element_at(F.array(*(F.lit(x) for x in (*text.ERROR_CODES, "OTHER"))), (k % 8 + 1).cast("int"))
    return net.table("part").select("p_partkey", text.distance_text(metres).alias("distance"), text.duration_text(seconds).alias("duration"), text.described(parts).alias("described"), text.error_code(reason).alias("code"))


@query
def edge_projections(net: Network) -> DataFrame:
    """Points within 2 m of an edge's line, as a share of it, and the edge's part up to there."""
    e = spatial.points_to_edges(net.points, net.edges.select("edge_id", "ulng", "ulat", "vlng", "vlat"), 30.0)
    line = F.array(F.struct(F.col("ulng").alias("lng"), F.col("ulat").alias("lat")), F.struct(F.col("vlng").alias("lng"), F.col("vlat").alias("lat")))
    at = e.withColumn("line", line).withColumn("share", polyline.share_along(F.col("line"), F.col("lng"), F.col("lat")))
    part = polyline.between_shares(F.col("line"), F.lit(0.0), F.col("share"))
    return at.where("share is not null").select("point_id", "edge_id", r("share", 7).alias("share"), r(F.element_at(part, -1)["lng"], 7).alias("end_lng"), r(F.element_at(part, -1)["lat"], 7).alias("end_lat"), r(geo.polyline_metres(part), 3).alias("metres"))


@query
def trace_lines(net: Network) -> DataFrame:
    """Each route's line: length, bounds, number of places once equal neighbours are joined, and its reversed start."""
    at = net.traces.groupBy("route_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lng", "lat"))), lambda p: F.struct(p["lng"], p["lat"])).alias("line"))
    b = polyline.bounds(F.col("line"))
    return at.select("route_id", r(geo.polyline_metres(F.col("line")), 3).alias("metres"), F.size(polyline.joined(F.col("line"), F.col("line"))).alias("joined"), *(r(b[c], 7).alias(c) for c in ("min_lng", "max_lng", "min_lat", "max_lat")), r(F.element_at(polyline.reversed_line(F.col("line")), 1)["lng"], 7).alias("last_lng"))


@query
def bbox_shifted(net: Network) -> DataFrame:
    """A box in the shifted system, and points shown in it, in answers that each keep the limit."""
    inside = spatial.in_bounds(net.points, (116.05, 39.65, 116.15, 39.75), "GCJ02")
    return spatial.paged(inside, "point_id", 5000).select("point_id", r("lng", 7).alias("lng"), r("lat", 7).alias("lat"))


@query
def control_area(net: Network) -> DataFrame:
    at = geo.to_gcj02(F.col("ax"), F.col("ay"))
    return net.ring_segments.select("ring", "seq", at.alias("p")).select("ring", "seq", r("p.lng", 7).alias("lng"), r("p.lat", 7).alias("lat"))


@query
def response_checks(net: Network) -> DataFrame:
    k = F.col("o_orderkey")
    mode = F.element_at(F.array(*map(F.lit, ("INTERNAL", "EXTERNAL_ONLY", "OUTBOUND", "INBOUND"))), (k % 4 + 1).cast("int"))
    rows = net.table("orders").select(k.alias("response_id"), mode.alias("mode"), (k % 3 != 0).alias("has_inside"), (k % 5 == 0).alias("has_reference"), (k % 7 != 0).alias("has_handover"), (k % 250).cast("double").alias("clearance"), (k % 9 * 25).cast("int").alias("radius"), (k % 4 + 2).cast("int").alias("n_points"))
    return build.response_violations(rows)


@query
def routing_modes(net: Network) -> DataFrame:
    from wayfold.operators.topology import planning_mode

    at = spatial.locate(net.nodes.select("node", "lng", "lat"), net.ring_segments, ["node"]).select("node", "location")
    ends = at.select((F.col("node") + 37).alias("node"), F.col("location").alias("there"))
    return at.join(ends, "node").select("node", planning_mode(F.col("location"), F.col("there")).alias("mode"))


@query
def through_corridors(net: Network) -> DataFrame:
    """Entry and exit edges that meet at a booth's node with a legal turn."""
    from wayfold.operators.choices import through_paths

    b = booths(net).select("node").distinct()
    ins = net.edge_keys.join(b.withColumnRenamed("node", "to_node"), "to_node").select(F.col("to_node").alias("node"), F.col("key").alias("entry_id"), F.col("edge_id").alias("last_edge"))
    outs = net.edge_keys.join(b.withColumnRenamed("node", "from_node"), "from_node").select(F.col("from_node").alias("node"), F.col("key").alias("exit_id"), F.col("edge_id").alias("first_edge"))
    return through_paths(ins, outs, net.forbidden_turns)


@query
def reference_spots(net: Network) -> DataFrame:
    from wayfold.operators.choices import reference_spot

    spots = net.table("lineitem").select(F.col("l_orderkey").alias("route_id"), F.col("l_linenumber").cast("double").alias("along_m"), (F.col("l_quantity") * 8).alias("clearance"))
    return reference_spot(spots)


@query
def closest_spots(net: Network) -> DataFrame:
    from wayfold.operators.choices import closest_to

    return closest_to(net.table("lineitem").select(F.col("l_orderkey").alias("route_id"), (F.col("l_quantity") * 10 + F.col("l_linenumber")).alias("along_m")))


@query
def moved_views(net: Network) -> DataFrame:
    from wayfold.operators.choices import viewport_changes

    e = net.table("events")
    views = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("zoom"), (F.col("value") / 1000).alias("lng"), (F.col("event_id") % 100 / 100).alias("lat"), F.lit(1.0).alias("span_lng"), F.lit(1.0).alias("span_lat"))
    return viewport_changes(views).select("session", "seq")


@query
def trace_phases(net: Network) -> DataFrame:
    from wayfold.operators.choices import phase_violations

    at = classified(net).select("edge_id", "mainline", (F.col("zone") == "INNER").alias("inside"))
    runs = ordered.edge_runs(net.traces).withColumn("edge_id", F.shiftright("edge_key", 1)).hint("merge").join(at, "edge_id")
    return phase_violations(runs.select("route_id", "run", "inside", "mainline", (F.col("edge_id") % 29 == 0).alias("released")))


@query
def latest_updates(net: Network) -> DataFrame:
    """Each user's update with the greatest sequence number, and whether it may be used a second after the last of all."""
    from wayfold.streaming import updates

    e = net.table("events").select("user_id", "ts", F.col("value").alias("accuracy"), F.col("event_id").alias("sequence"))
    now = e.agg(F.max("ts").alias("now"))
    seen = updates.usable(e.join(F.broadcast(now)), F.col("now")).drop("now")
    return updates.latest(seen).select("user_id", "sequence", "accuracy", "usable")


@query
def legal_turn_count(net: Network) -> DataFrame:
    return legal_turns(net).agg(F.count("*").alias("turns"), F.sum("next_mm").alias("total_mm"))


@query
def anchored_paths(net: Network) -> DataFrame:
    from wayfold.operators.topology import anchored_ways

    first = seeds(net).groupBy("request").agg(F.min("key").alias("first_key"))
    wanted = net.edge_keys.groupBy((F.col("from_node") + 25).alias("request")).agg(F.max("key").alias("last_key"))
    return anchored_ways(first.join(wanted, "request"), graph.adjacency(net.edge_keys, net.forbidden_turns), net.edge_keys)
