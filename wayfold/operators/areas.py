"""Lines against areas: side intervals, directed portals, traversal constraints and border lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import graph, spatial

# Tolerance of areas, of intervals and of fractions, and how far an area is shrunk to classify edges, in degrees or shares.
TOLERANCE_DEGREES, LEAST_INTERVAL, LEAST_FRACTION, SHRUNK_DEGREES = 1e-5, 1e-9, 1e-9, 1e-9


def side_intervals(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """(edge_id, k, start, stop, side, near_deg): an edge's stretches between the places where it meets the boundary.

    start and stop are fractions of the edge; side is where the stretch's middle lies, near_deg its distance in degrees from
    the boundary. Places are proper crossings and the boundary's points that lie on the edge.
    """
    met = spatial.crossings(edges.select("edge_id", "ulng", "ulat", "vlng", "vlat"), segments).select("edge_id", "fraction")
    ax, ay, bx, by, px, py = map(F.col, ("ulng", "ulat", "vlng", "vlat", "ax", "ay"))
    on = (F.abs((bx - ax) * (py - ay) - (by - ay) * (px - ax)) <= 1e-12) & px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))
    # the boundary's points meet edges on cells
    spots = segments.select(px.alias("lng"), py.alias("lat")).distinct()
    touching = spatial.points_to_edges(spots.withColumnsRenamed({"lng": "ax", "lat": "ay"}).withColumns({"lng": F.col("ax"), "lat": F.col("ay")}), edges.select("edge_id", "ulng", "ulat", "vlng", "vlat"), 1.0).where(on)
    vertex = touching.select("edge_id", geo.segment_fraction(px, py, ax, ay, bx, by).alias("fraction"))
    ends = edges.select("edge_id", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("fraction"))
    places = ends.unionByName(met).unionByName(vertex).distinct()
    w = Window.partitionBy("edge_id").orderBy("fraction")
    cut = places.withColumn("stop", F.lead("fraction").over(w)).where(F.col("stop") - F.col("fraction") > LEAST_INTERVAL)
    cut = cut.withColumn("k", F.row_number().over(w)).withColumnRenamed("fraction", "start")
    middle = (F.col("start") + F.col("stop")) / 2
    at = cut.join(edges.select("edge_id", "ulng", "ulat", "vlng", "vlat"), "edge_id").select("edge_id", "k", "start", "stop", geo.interpolate(ax, bx, middle).alias("lng"), geo.interpolate(ay, by, middle).alias("lat"))
    found = spatial.locate(at, segments, ["edge_id", "k"])
    return found.select("edge_id", "k", "start", "stop", F.col("location").alias("side"), "near_deg")


def directed_portals(intervals: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, edge_id, direction, kind, fraction): where a directed key leaves (OUT) or enters (IN) the area.

    A traversal crosses where a stretch on the target side follows one on the source side, with nothing but boundary between;
    then kind is OVERLAP, else INTERIOR. intervals as of side_intervals(); keys: key, edge_id; odd keys run backwards.
    """
    back = F.col("key").bitwiseAND(F.lit(1)) == 1
    run = intervals.join(keys.select("key", "edge_id"), "edge_id")
    run = run.select("key", "edge_id", "side", F.when(back, -F.col("k")).otherwise(F.col("k")).alias("k"), F.when(back, 1 - F.col("stop")).otherwise(F.col("start")).alias("fraction"))
    w = Window.partitionBy("key").orderBy("k")
    before = F.last(F.when(F.col("side") != "BOUNDARY", F.col("side")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seen = run.withColumn("before", before).withColumn("overlap", F.lag("side").over(w) == "BOUNDARY")
    out = F.when((F.col("before") == "INSIDE") & (F.col("side") == "OUTSIDE"), "OUT").when((F.col("before") == "OUTSIDE") & (F.col("side") == "INSIDE"), "IN")
    return seen.withColumn("direction", out).where("direction is not null").select("key", "edge_id", "direction", F.when(F.col("overlap"), "OVERLAP").otherwise("INTERIOR").alias("kind"), "fraction")


def portal_audit(intervals: DataFrame, portals: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: edges that meet the boundary, that run along it, with several crossings one way, distinct crossing places (at
    1e-8 degrees), and portals by direction."""
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0)).cast("bigint")
    each = intervals.groupBy("edge_id").agg(F.count("*").alias("n"), F.bool_or(F.col("side") == "BOUNDARY").alias("along"))
    by_edge = each.agg(n((F.col("n") > 1) | F.col("along")).alias("intersecting"), n(F.col("along")).alias("overlapping"))
    many = portals.groupBy("key", "direction").count().where("count > 1").agg(F.count("*").alias("ambiguous"))
    at = portals.join(edges, "edge_id").withColumn("t", F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, 1 - F.col("fraction")).otherwise(F.col("fraction")))
    place = at.select("direction", *(F.round(geo.interpolate(F.col(a), F.col(b), F.col("t")) * 1e8).cast("bigint").alias(c) for a, b, c in (("ulng", "vlng", "x"), ("ulat", "vlat", "y"))))
    rest = place.agg(F.count_distinct("x", "y").alias("crossings"), n(F.col("direction") == "OUT").alias("outbound"), n(F.col("direction") == "IN").alias("inbound"))
    return by_edge.join(many).join(rest)


def area_flags(intervals: DataFrame) -> DataFrame:
    """(edge_id, stays_within, avoids_interior): the whole edge against the area widened, or shrunk, by the tolerance."""
    close = F.col("near_deg") <= TOLERANCE_DEGREES
    within = (F.col("side") != "OUTSIDE") | close
    deep = (F.col("side") == "INSIDE") & ~close
    return intervals.groupBy("edge_id").agg(F.bool_and(within).alias("stays_within"), (~F.bool_or(deep)).alias("avoids_interior"))


def controlled_edges(edges: DataFrame, flags: DataFrame) -> DataFrame:
    """edges with `controlled_ok`: neither a highway's mainline nor a motorway link, and within the area."""
    joined = edges.join(flags.select("edge_id", "stays_within"), "edge_id", "left")
    return joined.withColumn("controlled_ok", ~F.col("mainline") & ~F.col("is_link") & F.coalesce("stays_within", F.lit(False))).drop("stays_within")


def released_ok(inner: Column, mainline: Column, is_link: Column, corridor: Column, bypass: Column, avoids_interior: Column) -> Column:
    """Whether an edge may be used once a route is released: never inner highways; always verified corridors, mainlines and
    bypasses; links outside the inner zone; others where they avoid the area's interior."""
    return F.when(inner & mainline, False).when(corridor | mainline | bypass, True).when(is_link, ~inner).otherwise(avoids_interior)


def meets_interior(intervals: DataFrame, shrunk: float = SHRUNK_DEGREES) -> DataFrame:
    """(edge_id): edges with a stretch inside the area, farther from its boundary than `shrunk` degrees."""
    return intervals.where((F.col("side") == "INSIDE") & (F.col("near_deg") > shrunk)).select("edge_id").distinct()


def covered(intervals: DataFrame) -> DataFrame:
    """(edge_id): edges that lie wholly in the area or on its boundary."""
    return intervals.groupBy("edge_id").agg(F.bool_and(F.col("side") != "OUTSIDE").alias("c")).where("c").select("edge_id")


def around(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """Edges whose box meets the segments' box, widened by the tolerance: all that can lie in the area, on its boundary or across it."""
    a, b, c, d = (f(F.least(x, y) if f is F.min else F.greatest(x, y)) for f, x, y in ((F.min, "ax", "bx"), (F.max, "ax", "bx"), (F.min, "ay", "by"), (F.max, "ay", "by")))
    box = segments.agg(*((v + w).alias(n) for v, w, n in ((a, -TOLERANCE_DEGREES, "west"), (b, TOLERANCE_DEGREES, "east"), (c, -TOLERANCE_DEGREES, "south"), (d, TOLERANCE_DEGREES, "north"))))
    meets = (F.greatest("ulng", "vlng") >= F.col("west")) & (F.least("ulng", "vlng") <= F.col("east")) & (F.greatest("ulat", "vlat") >= F.col("south")) & (F.least("ulat", "vlat") <= F.col("north"))
    return edges.join(F.broadcast(box), meets, "left_semi")


def classify_edges(edges: DataFrame, inner: DataFrame, second: DataFrame) -> DataFrame:
    """edges with zones and roles by geometry, class and identity: in_inner, in_second, link, mainline, ring, mismatch, exempt,
    forbidden, second_main.

    edges: edge_id, places of u and v, road_class, is_link, identity (the edge's way belongs to the ring's relation); inner and
    second: segments of the two areas. An edge is in the inner area if it meets its interior, else in the second one if that
    covers it. Motorways that aren't links are mainline. Edges of the relation are the ring if mainline, and a mismatch
    otherwise; the ring is exempt. Other mainline is forbidden in the inner area, exempt in the second one.
    """
    flag = lambda df, name: df.withColumn(name, F.lit(True))
    line = edges.select("edge_id", "ulng", "ulat", "vlng", "vlat")
    # only edges around an area are cut at its boundary: the others lie outside it
    stretches = lambda area: side_intervals(graph._cut(around(line, area), "edges-around"), area)
    met = edges.join(flag(meets_interior(stretches(inner)), "a"), "edge_id", "left").join(flag(covered(stretches(second)), "b"), "edge_id", "left")
    motorway = F.col("road_class") == "motorway"
    zoned = met.withColumns({"in_inner": F.col("a").isNotNull(), "in_second": F.col("a").isNull() & F.col("b").isNotNull(), "link": motorway & F.col("is_link")}).drop("a", "b")
    main = motorway & ~F.col("is_link")
    rest = main & ~F.col("identity")
    roles = {"mainline": main, "ring": main & F.col("identity"), "mismatch": ~main & F.col("identity"), "exempt": (main & F.col("identity")) | (rest & F.col("in_second")), "forbidden": rest & F.col("in_inner"), "second_main": rest & F.col("in_second")}
    return zoned.withColumns(roles)


def classification_counts(classified: DataFrame) -> DataFrame:
    """One row: edges of the ring's relation, of the ring, its distinct ways and drivable directions, mismatches; mainline of the
    second area, its distinct ways and drivable directions, and links there; `problem`: the first rule that fails, or null.

    classified: as of classify_edges(), with way_id, forward and reverse (whether cars may drive that way)."""
    n = lambda c: F.count_if(c).cast("bigint")
    ways = lambda c: F.count_distinct(F.when(F.col(c), F.col("way_id")))
    directions = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("forward").cast("int") + F.col("reverse").cast("int"))), F.lit(0)).cast("bigint")
    counts = classified.agg(
        n(F.col("identity")).alias("relation_edges"), n(F.col("ring")).alias("ring_edges"), ways("ring").alias("ring_ways"), directions("ring").alias("ring_directions"), n(F.col("mismatch")).alias("mismatches"),
        n(F.col("second_main")).alias("second_edges"), ways("second_main").alias("second_ways"), directions("second_main").alias("second_directions"), n(F.col("link") & F.col("in_second")).alias("second_links"),
    )
    least = lambda *cs: F.least(*map(F.col, cs)) <= 0
    problem = F.when(least("relation_edges", "ring_edges", "ring_ways", "ring_directions"), "no ring").when(F.col("mismatches") > 0, "relation and class differ").when(least("second_edges", "second_ways", "second_directions"), "no second mainline")
    return counts.withColumn("problem", problem)


def near_line(rows: DataFrame, line: DataFrame, metres: float, key: str) -> DataFrame:
    """rows (key, lng, lat) within `metres` of the line's segments (ax, ay, bx, by), by planar degrees; none if metres <= 0."""
    limit = metres / geo.METRES_PER_DEGREE
    edges = line.select(F.col("ax").alias("ulng"), F.col("ay").alias("ulat"), F.col("bx").alias("vlng"), F.col("by").alias("vlat"))
    # cells widened by more than the limit, whose degrees are the same in both directions
    met = spatial.points_to_edges(rows.select(key, "lng", "lat"), edges, max(metres, 0.001) * 1.5)
    t = geo.segment_fraction(*map(F.col, ("lng", "lat", "ulng", "ulat", "vlng", "vlat")))
    off = F.hypot(F.col("lng") - geo.interpolate(F.col("ulng"), F.col("vlng"), t), F.col("lat") - geo.interpolate(F.col("ulat"), F.col("vlat"), t))
    return met.where((off <= limit) & F.lit(metres > 0)).select(key).distinct()


def release_points(portals: DataFrame, edges: DataFrame, border: DataFrame, metres: float) -> DataFrame:
    """Portals (portal_id, edge_id, direction, lng, lat) on ordinary roads; inbound ones on the border line are left out.

    edges: edge_id, mainline, is_link; border: segments of the line.
    """
    plain = portals.join(edges.where("not mainline and not is_link").select("edge_id"), "edge_id", "left_semi")
    on = near_line(plain.where("direction = 'IN'"), border, metres, "portal_id")
    return plain.join(on.withColumn("on_border", F.lit(True)), "portal_id", "left").where("direction <> 'IN' or on_border is null").drop("on_border")
