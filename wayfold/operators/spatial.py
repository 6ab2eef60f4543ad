"""Spatial joins on grid cells, and predicates against polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import graph


def _cells(bounds: dict[str, Column], size: float) -> Column:
    """All grid cells that a box of degrees touches, as array<struct<cx, cy>>."""
    at = lambda c: F.floor(c / size).cast("bigint")
    row = lambda x: F.transform(F.sequence(at(bounds["min_lat"]), at(bounds["max_lat"])), lambda y: F.struct(x.alias("cx"), y.alias("cy")))
    return F.flatten(F.transform(F.sequence(at(bounds["min_lng"]), at(bounds["max_lng"])), row))


def _celled(rows: DataFrame, bounds: dict[str, Column], points: DataFrame, size: float) -> DataFrame:
    """rows in all cells that their box of degrees touches, within the box around all points: beyond it there is nothing to meet, and
    wide boxes near the poles, or far from every point, would take cells in vain."""
    around = points.agg(*(f(c).alias(f"__{n}_{c}") for c in ("lng", "lat") for n, f in (("min", F.min), ("max", F.max))))
    met = rows.withColumns({f"__{k}": v for k, v in bounds.items()}).crossJoin(F.broadcast(around.withColumnsRenamed({c: f"__all{c}" for c in around.columns})))
    clipped = {k: (F.greatest if k.startswith("min") else F.least)(f"__{k}", f"__all__{k}") for k in bounds}
    # spread before they are multiplied: a small file of many rows is read by one task
    met = met.where((clipped["min_lng"] <= clipped["max_lng"]) & (clipped["min_lat"] <= clipped["max_lat"])).repartition(*(f"__{k}" for k in bounds))
    return met.select(*rows.columns, F.explode(_cells(clipped, size)).alias("cell"))


def points_to_edges(points: DataFrame, edges: DataFrame, metres: float, cell: float = 0.005) -> DataFrame:
    """(point columns, edge columns, dist_m): pairs within `metres` of each other.

    Points go to the one cell that holds them, edges to all cells that their box, widened by the radius, touches: a pair meets
    in exactly one cell, so nothing has to be made distinct after the equi-join. Cells should be no smaller than the radius;
    edges much longer than a cell take as many rows as their box has cells.
    """
    low, high = (lambda a, b: F.least(F.col(a), F.col(b))), (lambda a, b: F.greatest(F.col(a), F.col(b)))
    lo, hi = geo.degree_envelope(low("ulng", "vlng"), low("ulat", "vlat"), metres), geo.degree_envelope(high("ulng", "vlng"), high("ulat", "vlat"), metres)
    # the smaller cosine of the two ends widens enough for both
    wide = F.greatest(*(geo.degree_envelope(F.lit(0.0), F.col(c), metres)["max_lng"] for c in ("ulat", "vlat")))
    bounds = {"min_lng": low("ulng", "vlng") - wide, "max_lng": high("ulng", "vlng") + wide, "min_lat": lo["min_lat"], "max_lat": hi["max_lat"]}
    e = _celled(edges, bounds, points, cell)
    p = points.withColumn("cell", F.struct(F.floor(F.col("lng") / cell).cast("bigint").alias("cx"), F.floor(F.col("lat") / cell).cast("bigint").alias("cy")))
    dist = geo.point_segment_metres(*map(F.col, ("lng", "lat", "ulng", "ulat", "vlng", "vlat")))
    return p.hint("merge").join(e, "cell").drop("cell").withColumn("dist_m", dist).where(F.col("dist_m") <= metres)


def points_within(points: DataFrame, centres: DataFrame, metres: float, cell: float = 0.005) -> DataFrame:
    """points x centres (lng, lat renamed clng, clat) within `metres` by great circle, with dist_m."""
    bounds = geo.degree_envelope(F.col("clng"), F.col("clat"), metres)
    c = centres.withColumnsRenamed({"lng": "clng", "lat": "clat"})
    c = _celled(c, bounds, points, cell)
    p = points.withColumn("cell", F.struct(F.floor(F.col("lng") / cell).cast("bigint").alias("cx"), F.floor(F.col("lat") / cell).cast("bigint").alias("cy")))
    return p.hint("merge").join(c, "cell").drop("cell").withColumn("dist_m", geo.haversine(*map(F.col, ("lng", "lat", "clng", "clat")))).where(F.col("dist_m") <= metres)


def nearest_edge(points: DataFrame, edges: DataFrame, point_id: str, most: float | None = None, first: float = 500.0) -> DataFrame:
    """Every point with its nearest edge (ties: smallest id) and the distance, found in widening rings.

    Each round joins the points that have no edge yet within its radius, four times the last one's, on cells of that size; a
    nearest edge within the radius is the nearest of all. Rounds end when every point has one, or at `most` metres if given,
    else at the earth's half girth: only then, without edges, and for points without a place, are there nulls. Points at one
    place are searched for once.
    """
    columns, radius, found = points.columns, first, None
    reach = most if most is not None else 20_100_000.0
    if edges.isEmpty():
        return points.withColumns({"edge_id": F.lit(None).cast("bigint"), "dist_m": F.lit(None).cast("double")})
    left = graph._cut(points.select("lng", "lat").where("lng is not null and lat is not null").distinct(), "nearest-places")
    while True:
        radius = min(radius, reach)
        near = points_to_edges(left, edges, radius, max(0.005, radius / 111_320 / 2))
        best = near.groupBy("lng", "lat").agg(F.min(F.struct(F.round("dist_m", 6).alias("d"), "edge_id", "dist_m")).alias("best"))
        best = graph._cut(best.select("lng", "lat", "best.edge_id", "best.dist_m"), "nearest")
        found = best if found is None else found.unionByName(best)
        left = graph._cut(left.join(best, ["lng", "lat"], "left_anti"), "nearest-left")
        if radius >= reach or left.isEmpty():
            return points.join(found.hint("merge"), ["lng", "lat"], "left").select(*columns, "edge_id", "dist_m")
        radius *= 4


def snapped(points: DataFrame, edges: DataFrame, point_id: str, most: float | None = None) -> DataFrame:
    """points with the nearest of `edges` (only those that may be used), the share of it at which the nearest place lies (to 9
    digits), that place, and `valid`: whether there is an edge within `most` metres, if given. An invalid point has nulls."""
    near = nearest_edge(points.select(point_id, "lng", "lat"), edges.select("edge_id", "ulng", "ulat", "vlng", "vlat"), point_id, most)
    at = near.join(edges.select("edge_id", "ulng", "ulat", "vlng", "vlat"), "edge_id", "left")
    share = F.round(geo.segment_fraction(*map(F.col, ("lng", "lat", "ulng", "ulat", "vlng", "vlat"))), 9)
    at = at.withColumn("valid", F.col("edge_id").isNotNull()).withColumn("fraction", F.when(F.col("valid"), share))
    on = lambda a, b: geo.interpolate(F.col(a), F.col(b), F.col("fraction"))
    return at.select(point_id, "edge_id", "fraction", on("ulng", "vlng").alias("on_lng"), on("ulat", "vlat").alias("on_lat"), "dist_m", "valid")


def in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """points x boxes (min_lng, max_lng, min_lat, max_lat), borders included; boxes are a stated query set and are broadcast."""
    inside = F.col("lng").between(F.col("min_lng"), F.col("max_lng")) & F.col("lat").between(F.col("min_lat"), F.col("max_lat"))
    return points.join(F.broadcast(boxes), inside)


def in_bounds(points: DataFrame, bounds: tuple[float, float, float, float], crs: str = "WGS84") -> DataFrame:
    """points in (min_lng, min_lat, max_lng, max_lat), borders included, shown and compared in the asked system, WGS84 or GCJ02.
    Bounds that aren't valid coordinates in order, or another system, are refused."""
    a, b, c, d = bounds
    if crs not in ("WGS84", "GCJ02"):
        raise ValueError(f"unknown coordinate system {crs}")
    if not (all(-180 <= x <= 180 for x in (a, c)) and all(-90 <= y <= 90 for y in (b, d))):
        raise ValueError("bounds are no coordinates")
    if a >= c or b >= d:
        raise ValueError("bounds must rise from the first corner to the second")
    if crs == "GCJ02":
        at = geo.to_gcj02(F.col("lng"), F.col("lat"))
        points = points.withColumn("at", at).withColumns({"lng": F.col("at.lng"), "lat": F.col("at.lat")}).drop("at")
    return points.where(F.col("lng").between(a, c) & F.col("lat").between(b, d))


def points_in_bounds(points: DataFrame, bounds: tuple[float, float, float, float], crs: str = "WGS84", most: int = 5000) -> DataFrame:
    """in_bounds() by id, as one answer: over `most` points are an error."""
    return limited(in_bounds(points, bounds, crs), "point_id", most)


def limited(rows: DataFrame, key: str, most: int) -> DataFrame:
    """rows by key, and an error, not a cut, if there are over `most`; one more row than allowed is all that is read to tell."""
    top = rows.orderBy(key).limit(most + 1)
    counted = top.withColumn("__n", F.count("*").over(Window.partitionBy(F.lit(0))))
    return counted.where(F.when(F.col("__n") > most, F.raise_error(F.lit(f"over {most} rows")).cast("boolean")).otherwise(F.lit(True))).drop("__n")


def paged(rows: DataFrame, key: str, most: int) -> DataFrame:
    """rows with `page`, from 0: the answers of at most `most` rows each, by a unique key, in which a caller whose rows are more than
    one answer may hold (see limited()) gets them all, however many share a place."""
    from wayfold.operators import ordered

    placed = ordered.running_sums(rows.withColumn("__one", F.lit(1).cast("bigint")), "__one", key)
    return placed.select(*rows.columns, F.expr(f"(upto - 1) div {most}").alias("page"))


#: Cells of located points start here, off the round values that boundaries like, and each level of cells has so many times the size.
_ORIGIN, _FACTOR = -0.000123456789, 8


def _on(px: Column, py: Column, s: Column) -> Column:
    """Whether a place lies on a segment (struct ax, ay, bx, by)."""
    ax, ay, bx, by = s["ax"], s["ay"], s["bx"], s["by"]
    return (F.abs((bx - ax) * (py - ay) - (by - ay) * (px - ax)) <= 1e-12) & px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))


def _nearest(px: Column, py: Column, segments: Column) -> Column:
    """Of each of an array of segments the place (x, y) nearest to a given one, with the squared degrees to it (d)."""
    t = lambda s: geo.segment_fraction(px, py, s["ax"], s["ay"], s["bx"], s["by"])
    spot = lambda s, t: F.struct(geo.interpolate(s["ax"], s["bx"], t).alias("x"), geo.interpolate(s["ay"], s["by"], t).alias("y"))
    spots = F.zip_with(segments, F.transform(segments, t), spot)
    return F.transform(spots, lambda a: F.struct(a["x"].alias("x"), a["y"].alias("y"), ((px - a["x"]) * (px - a["x"]) + (py - a["y"]) * (py - a["y"])).alias("d")))


def _over(px: Column, py: Column, s: Column) -> tuple[Column, Column]:
    """(whether a level ray at py meets a segment, where); an end on the ray counts as below it."""
    ax, ay, bx, by = s["ax"], s["ay"], s["bx"], s["by"]
    return (ay > py) != (by > py), (bx - ax) * (py - ay) / F.nullif(by - ay, F.lit(0.0)) + ax


def polygon_cells(cells: DataFrame, segments: DataFrame, cell: float) -> DataFrame:
    """cells (cx, cy) with `segments`, all that can be nearest to a place in the cell or meet it, and `odd`, whether a ray to the
    right from the cell's lower right corner meets the boundary an odd number of times.

    Cells are refined level by level: of a cell's segments those go on to its parts whose distance from the part's middle is not
    greater than the least by more than the part's girth. A large boundary is so cut down for all cells at once, by joins on the
    cell above; only the top level meets all segments, dealt by salt. Corners are counted along each line of cells that the
    boundary crosses.
    """
    both = cells.select(F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    span = max(both[1] - both[0], both[3] - both[2]) + 1 if both[0] is not None else 1
    levels = 1
    while _FACTOR**levels < span:
        levels += 1
    salts = 16
    seg = F.struct("ax", "ay", "bx", "by")
    own = segments.select(seg.alias("s"))
    found = own.select(F.pmod(F.hash("s"), F.lit(salts)).alias("px"), F.lit(0).cast("bigint").alias("py"), "s")
    for level in range(levels - 1, -1, -1):
        size = _FACTOR**level
        at = lambda c: F.floor(F.col(c) / size).cast("bigint")  # noqa: E731, B023
        some = cells.select(at("cx").alias("x"), at("cy").alias("y")).distinct()
        if level == levels - 1:
            some = some.select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("px"), F.lit(0).cast("bigint").alias("py"))
        else:
            some = some.select("x", "y", F.floor(F.col("x") / _FACTOR).cast("bigint").alias("px"), F.floor(F.col("y") / _FACTOR).cast("bigint").alias("py"))
        mid = lambda c: (F.col(c) + 0.5) * (cell * size) + _ORIGIN  # noqa: E731, B023
        met = some.join(found, ["px", "py"]).select("x", "y", "s", F.sqrt(F.get(_nearest(mid("x"), mid("y"), F.array("s")), F.lit(0))["d"]).alias("d"))
        near = met.withColumn("least", F.min("d").over(Window.partitionBy("x", "y")))
        found = near.where(F.col("d") <= F.col("least") + cell * size * 1.4143).select(F.col("x").alias("px"), F.col("y").alias("py"), "s")
    listed = found.groupBy(F.col("px").alias("cx"), F.col("py").alias("cy")).agg(F.collect_list("s").alias("segments"))
    # where the boundary crosses the lower lines of cells
    low, high = F.least("s.ay", "s.by"), F.greatest("s.ay", "s.by")
    line = lambda y: F.floor((y - _ORIGIN) / cell).cast("bigint")
    rows = own.select("s", F.explode(F.sequence(line(low), line(high) + 1)).alias("cy")).join(cells.select("cy").distinct(), "cy", "left_semi")
    crosses, x = _over(F.lit(0.0), F.col("cy") * cell + _ORIGIN, F.col("s"))
    marks = rows.where(crosses).select("cy", x.alias("x"), F.lit(None).cast("bigint").alias("cx"))
    corners = cells.select("cy", ((F.col("cx") + 1) * cell + _ORIGIN).alias("x"), "cx")
    w = Window.partitionBy("cy").orderBy(F.desc("x"), F.col("cx").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.unionByName(corners).withColumn("n", F.count_if(F.col("cx").isNull()).over(w)).where("cx is not null")
    return listed.join(counted.select("cx", "cy", (F.col("n") % 2 == 1).alias("odd")), ["cx", "cy"])


def locate(points: DataFrame, segments: DataFrame, keys: list[str], cell: float = 0.01) -> DataFrame:
    """points with `location` (BOUNDARY, INSIDE or OUTSIDE), `outside_m` (0 but outside) and `near_deg` (planar degrees from the
    boundary) from ring segments (ax, ay, bx, by).

    Even-odd over all rings, so that holes are outside; the boundary is tested first. A point meets its cell's segments only (see
    polygon_cells()): a path from it goes right to the cell's edge and down to its corner, and crosses the boundary there as often
    as the cell's segments say, and beyond as the corner's count says. Points are joined with their cell once, and never grouped;
    a crowded cell is one row on the other side. Without segments nothing is inside, and distances are null.
    """
    at = lambda c: F.floor((F.col(c) - _ORIGIN) / cell).cast("bigint")
    rows = points.withColumns({"__cx": at("lng"), "__cy": at("lat")})
    used = graph._cut(rows.select(F.col("__cx").alias("cx"), F.col("__cy").alias("cy")).where("cx is not null and cy is not null").distinct(), "point-cells")
    cells = polygon_cells(used, segments, cell).withColumnsRenamed({"cx": "__cx", "cy": "__cy", "segments": "__s", "odd": "__odd"})
    px, py = F.col("lng"), F.col("lat")
    right, low = (F.col("__cx") + 1) * cell + _ORIGIN, F.col("__cy") * cell + _ORIGIN

    def level(s: Column) -> Column:
        meets, x = _over(px, py, s)
        return F.coalesce(meets & (px < x) & (x <= right), F.lit(False))

    def upright(s: Column) -> Column:
        meets = (s["ax"] > right) != (s["bx"] > right)
        y = (s["by"] - s["ay"]) * (right - s["ax"]) / F.nullif(s["bx"] - s["ax"], F.lit(0.0)) + s["ay"]
        return F.coalesce(meets & (y > low) & (y <= py), F.lit(False))

    crossed = F.size(F.filter("__s", level)) + F.size(F.filter("__s", upright)) + F.col("__odd").cast("int")
    place = F.when(F.exists("__s", lambda s: _on(px, py, s)), "BOUNDARY").when(crossed % 2 == 1, "INSIDE").otherwise("OUTSIDE")
    met = rows.join(cells, ["__cx", "__cy"], "left").withColumns({"location": place, "__at": _nearest(px, py, F.col("__s"))})
    met = met.withColumn("__d", F.array_min(F.transform("__at", lambda a: a["d"])))
    metres = F.array_min(F.transform(F.filter("__at", lambda a: a["d"] == F.col("__d")), lambda a: geo.haversine(px, py, a["x"], a["y"])))
    return met.select(*points.columns, "location", F.when(F.col("location") == "OUTSIDE", metres).otherwise(0.0).alias("outside_m"), F.sqrt("__d").alias("near_deg"))


def map_facilities(facilities: DataFrame, nodes: DataFrame, metres: float = 3.0, cell: float = 5e-5) -> DataFrame:
    """(facility_id, node): for each facility the node within `metres` that shares most ways, then is nearest, then lowest.

    facilities: facility_id, flng, flat, ways; nodes: node, lng, lat, ways (arrays). A facility with ways matches only nodes
    that share one.
    """
    at = lambda c: F.floor(F.col(c) / cell).cast("bigint")
    around = F.explode(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda j: F.struct((at("flng") + i).alias("cx"), (at("flat") + j).alias("cy"))))))
    f = facilities.withColumnRenamed("ways", "own_ways").withColumn("cell", around)
    n = nodes.withColumn("cell", F.struct(at("lng").alias("cx"), at("lat").alias("cy")))
    met = f.join(n, "cell").withColumn("d", geo.haversine(*map(F.col, ("flng", "flat", "lng", "lat")))).withColumn("shared", F.size(F.array_intersect("own_ways", "ways")))
    good = met.where((F.col("d") <= metres) & ((F.size("own_ways") == 0) | (F.col("shared") > 0)))
    return good.groupBy("facility_id").agg(F.min(F.struct((-F.col("shared")).alias("s"), F.round("d", 6).alias("d"), "node")).alias("best")).select("facility_id", "best.node", (-F.col("best.s")).alias("shared_ways"), F.col("best.d").alias("dist_m"))


def crossings(edges: DataFrame, segments: DataFrame, cell: float = 0.02) -> DataFrame:
    """Proper crossings of edges with ring segments: edge_id, fraction along the edge, place, and whether the edge enters there.

    Both sides go to all cells that their boxes touch and meet by an equi-join, however many segments there are; a pair counts in
    the first cell that both boxes share.
    """
    box = lambda a, b, c, d: {"min_lng": F.least(a, c), "max_lng": F.greatest(a, c), "min_lat": F.least(b, d), "max_lat": F.greatest(b, d)}
    at = lambda c: F.floor(c / cell).cast("bigint")
    ax, ay, bx, by = (F.col(c) for c in ("ulng", "ulat", "vlng", "vlat"))
    cx, cy, dx, dy = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    e = edges.withColumn("cell", F.explode(_cells(box(ax, ay, bx, by), cell)))
    s = segments.withColumn("cell", F.explode(_cells(box(cx, cy, dx, dy), cell)))
    first = (F.col("cell.cx") == F.greatest(at(F.least(ax, bx)), at(F.least(cx, dx)))) & (F.col("cell.cy") == F.greatest(at(F.least(ay, by)), at(F.least(cy, dy))))
    det = F.nullif((bx - ax) * (dy - cy) - (by - ay) * (dx - cx), F.lit(0.0))
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det
    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
    met = e.join(s, "cell").where(first & det.isNotNull()).drop("cell").withColumn("fraction", t).withColumn("s", u)
    met = met.where("fraction >= 0 and fraction <= 1 and s >= 0 and s < 1")
    return met.withColumn("lng", geo.interpolate(ax, bx, F.col("fraction"))).withColumn("lat", geo.interpolate(ay, by, F.col("fraction"))).drop("s")


def second_largest(rings: DataFrame, name: str) -> DataFrame:
    """The ring with the second largest shoelace area, from rows (name, seq, ax, ay, bx, by)."""
    area = F.abs(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"))) / 2
    sized = rings.groupBy(name).agg(area.alias("area"))
    return sized.withColumn("place", F.row_number().over(Window.orderBy(F.desc("area"), name))).where("place = 2").drop("place")
