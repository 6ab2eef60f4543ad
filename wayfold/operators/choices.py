"""Choices along a route, and the rules of a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Road classes that navigation may hand over on.
RELIABLE = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential")


def navigable(road_class: Column, link: Column, tunnel: Column, ferry: Column) -> Column:
    return road_class.isin(*RELIABLE) & ~link & ~tunnel & ~ferry


def reference_spot(spots: DataFrame, clear: float = 250.0) -> DataFrame:
    """Of each route's spots (route_id, along_m, clearance) the nearest with enough clearance, else the clearest (ties: nearest)."""
    good = F.col("clearance") >= clear
    order = F.struct((~good).cast("int"), F.when(good, 0.0).otherwise(-F.col("clearance")), F.col("along_m"))
    return spots.groupBy("route_id").agg(F.min(F.struct(order.alias("o"), "along_m", "clearance")).alias("b")).select("route_id", "b.along_m", "b.clearance")


def closest_to(spots: DataFrame, target: float = 300.0) -> DataFrame:
    """Of each route's spots the one whose distance along is closest to `target`, then the smaller distance."""
    return spots.groupBy("route_id").agg(F.min(F.struct(F.abs(F.col("along_m") - target).alias("off"), "along_m")).alias("b")).select("route_id", "b.along_m")


def phase_violations(runs: DataFrame) -> DataFrame:
    """(route_id, run) of runs that break the phases: controlled runs use no mainline and stay inside, and once a route is
    released (its first run with `released`), no run may be inside on a mainline. runs: route_id, run, inside, mainline, released."""
    first = F.min(F.when(F.col("released"), F.col("run"))).over(Window.partitionBy("route_id"))
    marked = runs.withColumn("first", first).withColumn("after", F.coalesce(F.col("run") >= F.col("first"), F.lit(False)))
    bad = F.when(F.col("after"), F.col("inside") & F.col("mainline")).otherwise(F.col("mainline") | ~F.col("inside"))
    return marked.where(bad).select("route_id", "run")


def viewport_changes(views: DataFrame, share: float = 0.08) -> DataFrame:
    """Views (session, seq, zoom, lng, lat, span_lng, span_lat) that differ from the one before: another zoom, or a centre
    moved by over `share` of the span; a session's first view counts."""
    w = Window.partitionBy("session").orderBy("seq")
    moved = lambda c, span: F.abs(F.col(c) - F.lag(c).over(w)) > share * F.col(span)
    changed = F.lag("zoom").over(w).isNull() | (F.col("zoom") != F.lag("zoom").over(w)) | moved("lng", "span_lng") | moved("lat", "span_lat")
    return views.withColumn("changed", F.coalesce(changed, F.lit(True))).where("changed").drop("changed")


def through_paths(entries: DataFrame, exits: DataFrame, banned: DataFrame) -> DataFrame:
    """Entry and exit corridors that meet at a node with a legal turn: (node, entry_id, exit_id).

    entries: node, entry_id, last_edge; exits: node, exit_id, first_edge; banned: from_edge, via_node, to_edge.
    """
    met = entries.join(exits, "node").select("node", "entry_id", "exit_id", F.col("last_edge").alias("from_edge"), F.col("node").alias("via_node"), F.col("first_edge").alias("to_edge"))
    return met.join(banned, ["from_edge", "via_node", "to_edge"], "left_anti").select("node", "entry_id", "exit_id")
