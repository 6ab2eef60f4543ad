"""Union of areas: borders cut where they meet, kept where one side alone is inside, and linked to rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import graph, spatial

#: Coordinates are whole numbers of this part of a degree once borders are cut: places nearer than it are one.
UNITS = 1_000_000_000


def _whole(c: Column) -> Column:
    return F.round(c * UNITS).cast("bigint")


def cut_borders(parts: DataFrame, cell: float = 0.02) -> DataFrame:
    """(part, x1, y1, x2, y2): the sides of all parts (part, ax, ay, bx, by), cut at each place where two of them cross, meet or
    overlap, in UNITS, each from its lesser end.

    Sides meet on grid cells, a pair in the first cell that both share; a part's own sides are cut by each other too. Sides that
    lie twice in one part cancel."""
    at = lambda c: F.floor(F.col(c) / cell).cast("bigint")
    low, high = (lambda a, b: F.least(F.col(a), F.col(b))), (lambda a, b: F.greatest(F.col(a), F.col(b)))
    sides = graph._cut(parts.select("part", "ax", "ay", "bx", "by").distinct().withColumn("id", F.monotonically_increasing_id()), "polygon-sides")
    pad = 2.0 / UNITS
    box = {"min_lng": low("ax", "bx") - pad, "max_lng": high("ax", "bx") + pad, "min_lat": low("ay", "by") - pad, "max_lat": high("ay", "by") + pad}
    own = sides.select("id", "ax", "ay", "bx", "by", *(c.alias(n) for n, c in box.items())).withColumn("cell", F.explode(spatial._cells({n: F.col(n) for n in box}, cell)))
    other = own.select("cell", *(F.col(c).alias(f"o_{c}") for c in own.columns if c != "cell"))
    first = (F.col("cell.cx") == F.greatest(at("min_lng"), at("o_min_lng"))) & (F.col("cell.cy") == F.greatest(at("min_lat"), at("o_min_lat")))
    # a cell's sides are many pairs: they are dealt by cell, and only pairs whose boxes meet are measured
    boxed = (F.col("o_min_lng") <= F.col("max_lng")) & (F.col("min_lng") <= F.col("o_max_lng")) & (F.col("o_min_lat") <= F.col("max_lat")) & (F.col("min_lat") <= F.col("o_max_lat"))
    met = own.hint("merge").join(other, "cell").where((F.col("id") != F.col("o_id")) & first & boxed)
    ax, ay, bx, by, cx, cy, dx, dy = map(F.col, ("ax", "ay", "bx", "by", "o_ax", "o_ay", "o_bx", "o_by"))
    det = F.nullif((bx - ax) * (dy - cy) - (by - ay) * (dx - cx), F.lit(0.0))
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det
    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
    crossing = F.when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), F.struct(t.alias("t"), geo.interpolate(ax, bx, t).alias("x"), geo.interpolate(ay, by, t).alias("y")))

    def touching(px: Column, py: Column) -> Column:
        """An end of the other side that lies on this one."""
        s = geo.segment_fraction(px, py, ax, ay, bx, by)
        off = F.greatest(F.abs(geo.interpolate(ax, bx, s) - px), F.abs(geo.interpolate(ay, by, s) - py))
        return F.when(off <= 1.0 / UNITS, F.struct(s.alias("t"), px.alias("x"), py.alias("y")))

    found = met.select("id", F.explode(F.array_compact(F.array(crossing, touching(cx, cy), touching(dx, dy)))).alias("p")).select("id", "p.*")
    ends = sides.select("id", F.explode(F.array(F.struct(F.lit(0.0).alias("t"), ax.alias("x"), ay.alias("y")), F.struct(F.lit(1.0).alias("t"), bx.alias("x"), by.alias("y")))).alias("p")).select("id", "p.*")
    spots = found.unionByName(ends).select("id", "t", _whole(F.col("x")).alias("x"), _whole(F.col("y")).alias("y")).groupBy("id", "x", "y").agg(F.min("t").alias("t"))
    w = Window.partitionBy("id").orderBy("t", "x", "y")
    pieces = spots.select("id", F.struct("x", "y").alias("p"), F.lead(F.struct("x", "y")).over(w).alias("q")).where("q is not null")
    p, q = F.least("p", "q"), F.greatest("p", "q")
    named = pieces.join(sides.select("id", "part"), "id").select("part", p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    return named.groupBy(*named.columns).agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")


def union_border(parts: DataFrame, cell: float = 0.02) -> DataFrame:
    """(x1, y1, x2, y2): the border of the union of parts (part, ax, ay, bx, by), in UNITS, directed so that the inside is on the left.

    A part is inside by even-odd over its own sides. A piece of border counts if just one side of it is in some part: a ray from
    its middle, to the right, or up from a level piece, crosses a part's other pieces an odd number of times if that side is in
    it. Middles meet only parts whose box holds them, on cells, and of these only the pieces in the ray's band of cells; so borders
    of touching areas go, and holes stay, whatever the number of parts."""
    pieces = graph._cut(cut_borders(parts, cell), "polygon-pieces")
    size = cell * UNITS
    level = F.col("y1") == F.col("y2")
    # everything as (a along the ray's band, b along the ray): a level piece's ray goes up
    turned = lambda df, up: df.select("part", "x1", "y1", "x2", "y2", F.lit(up).alias("up"), *(F.col(c).alias(n) for c, n in zip(("x1", "y1", "x2", "y2") if up else ("y1", "x1", "y2", "x2"), ("a1", "b1", "a2", "b2"), strict=True)))
    of = lambda c: F.floor(c / size).cast("bigint")
    walls = turned(pieces, False).unionByName(turned(pieces, True)).withColumn("band", F.explode(F.sequence(of(F.least("a1", "a2")), of(F.greatest("a1", "a2")))))
    border = pieces.select("x1", "y1", "x2", "y2").distinct().withColumns({"up": level, "mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2})
    boxes = pieces.groupBy("part").agg(F.min("x1").alias("min_lng"), F.max("x2").alias("max_lng"), F.min(F.least("y1", "y2")).alias("min_lat"), F.max(F.greatest("y1", "y2")).alias("max_lat"))
    boxes = boxes.withColumn("cell", F.explode(spatial._cells({n: F.col(n) for n in ("min_lng", "max_lng", "min_lat", "max_lat")}, size)))
    mids = border.withColumn("cell", F.struct(of(F.col("mx")).alias("cx"), of(F.col("my")).alias("cy")))
    near = mids.join(boxes, "cell").where(F.col("mx").between(F.col("min_lng"), F.col("max_lng")) & F.col("my").between(F.col("min_lat"), F.col("max_lat")))
    near = near.select("part", "up", F.struct("x1", "y1", "x2", "y2").alias("e"), F.when(F.col("up"), F.col("mx")).otherwise(F.col("my")).alias("a"), F.when(F.col("up"), F.col("my")).otherwise(F.col("mx")).alias("b")).withColumn("band", of(F.col("a")))
    wall = walls.select("part", "up", "band", F.struct("x1", "y1", "x2", "y2").alias("s"), "a1", "b1", "a2", "b2")
    met = near.join(wall, ["part", "up", "band"], "left")
    at = F.col("b1") + (F.col("b2") - F.col("b1")) * (F.col("a") - F.col("a1")) / F.nullif((F.col("a2") - F.col("a1")).cast("double"), F.lit(0.0))
    over = ((F.col("a1") > F.col("a")) != (F.col("a2") > F.col("a"))) & (F.col("b") < at) & (F.col("s") != F.col("e"))
    each = met.groupBy("part", "e").agg((F.count_if(F.coalesce(over, F.lit(False))) % 2 == 1).alias("plus"), F.bool_or(F.coalesce(F.col("s") == F.col("e"), F.lit(False))).alias("own_in_band"))
    own = pieces.select("part", F.struct("x1", "y1", "x2", "y2").alias("e"), F.lit(True).alias("own"))
    sides = each.join(own, ["part", "e"], "left").select("e", "plus", (F.col("plus") != F.col("own").isNotNull()).alias("minus"))
    both = sides.groupBy("e").agg(F.bool_or("plus").alias("plus"), F.bool_or("minus").alias("minus")).where("plus <> minus")
    # a piece goes from its lesser end: to the right, or up; the ray's side is on its left if the piece falls or is level
    left = F.when(F.col("e.y2") > F.col("e.y1"), F.col("minus")).otherwise(F.col("plus"))
    swap = lambda a, b: F.when(left, F.col(f"e.{a}")).otherwise(F.col(f"e.{b}")).alias(a)
    return both.select(swap("x1", "x2"), swap("y1", "y2"), swap("x2", "x1"), swap("y2", "y1"))


def rings_of(border: DataFrame) -> DataFrame:
    """(ring, seq, lng, lat): the closed rings of a directed border, each from its least point; outer rings run with the inside on
    the left, and so do holes, whose signed area is negative.

    At a place where several rings meet, a piece goes on with the first one clockwise from where it came, so that each stretch of
    inside has its own ring. Rings are numbered by joins (graph.cycles()), so that they may be of any length."""
    rows = border.select("x1", "y1", "x2", "y2", F.xxhash64("x1", "y1", "x2", "y2").alias("h"))
    rows = graph._cut(rows, "border-pieces")
    on = rows.select(F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("x2").alias("x3"), F.col("y2").alias("y3"), F.col("h").alias("next"))
    back = F.atan2((F.col("y1") - F.col("y2")).cast("double"), (F.col("x1") - F.col("x2")).cast("double"))
    ahead = F.atan2((F.col("y3") - F.col("y2")).cast("double"), (F.col("x3") - F.col("x2")).cast("double"))
    turn = back - ahead
    clockwise = F.when(turn <= 1e-12, turn + 6.283185307179586).otherwise(turn)
    linked = rows.join(on, ["x2", "y2"]).groupBy("h", "x1", "y1").agg(F.min_by("next", clockwise).alias("next"))
    linked = graph._cut(linked.withColumnRenamed("h", "node"), "border-links")
    at = graph._cut(graph.cycles(linked, "x1", "y1").join(linked, "node").select(F.col("first").alias("ring"), F.col("seq").cast("int").alias("seq"), (F.col("x1") / UNITS).alias("lng"), (F.col("y1") / UNITS).alias("lat")), "ring-places")
    # a closed ring ends where it starts
    sizes = at.groupBy("ring").agg(F.count("*").cast("int").alias("seq"))
    return at.unionByName(at.where("seq = 0").drop("seq").join(sizes, "ring").select("ring", "seq", "lng", "lat"))


def signed_areas(rings: DataFrame) -> DataFrame:
    """(ring, points, area): sides and signed area in square degrees of closed rings (ring, seq, lng, lat), measured from each ring's
    first point, so that small rings lose no digits."""
    first = rings.where("seq = 0").select("ring", F.col("lng").alias("x0"), F.col("lat").alias("y0"))
    after = rings.select("ring", (F.col("seq") - 1).alias("seq"), F.col("lng").alias("nlng"), F.col("lat").alias("nlat"))
    x, y, nx, ny = (F.col(c) - F.col(o) for c, o in (("lng", "x0"), ("lat", "y0"), ("nlng", "x0"), ("nlat", "y0")))
    # rows meet by ring and place, and sums are begun before rings meet, so that a long ring is spread over tasks
    step = rings.join(after, ["ring", "seq"]).join(first, "ring")
    return step.groupBy("ring").agg(F.count("*").alias("points"), (F.sum(x * ny - nx * y) / 2).alias("area"))


def union_report(parts: DataFrame, rings: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """One row: area of the union and sum of the parts' areas (each by even-odd, from its own border), outer rings, holes, and
    whether the areas are equal within `tolerance`: then the parts only touch."""
    one = signed_areas(rings).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"), F.coalesce(F.count_if(F.col("area") > 0), F.lit(0)).alias("outer"), F.coalesce(F.count_if(F.col("area") < 0), F.lit(0)).alias("holes"))
    steps = parts.select("part", "ring", (F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")).alias("c"))
    each = steps.groupBy("part", "ring").agg((F.sum("c") / 2).alias("a"))
    # of a part's rings the first is its outline, the others are holes
    total = each.agg(F.coalesce(F.sum(F.when(F.col("ring") == 0, F.abs("a")).otherwise(-F.abs("a"))), F.lit(0.0)).alias("parts_area"))
    return one.join(total).withColumn("only_touch", F.abs(F.col("area") - F.col("parts_area")) <= tolerance)
