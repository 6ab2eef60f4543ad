"""Operators over ordered rows: runs, distances along a line, resampling, subsequences, choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import graph


def edge_runs(traces: DataFrame) -> DataFrame:
    """(route_id, run, edge_key, first_seq, last_seq, n_points): maximal stretches of one known edge key; repeated places count once."""
    w = Window.partitionBy("route_id").orderBy("seq")
    known = traces.where("edge_key >= 0")
    # unknown keys are skipped, they don't end a run of the key around them
    marked = known.withColumn("new", (~F.col("edge_key").eqNullSafe(F.lag("edge_key").over(w))).cast("int"))
    # within a run the known point before is the run's own, so one order by route and seq serves all
    again = (F.col("new") == 0) & F.col("lng").eqNullSafe(F.lag("lng").over(w)) & F.col("lat").eqNullSafe(F.lag("lat").over(w))
    runs = marked.withColumn("again", again).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("fresh", (~F.col("again")).cast("int")).groupBy("route_id", "run", "edge_key").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("fresh").alias("n_points"))


def cumulative(traces: DataFrame) -> DataFrame:
    """traces with step_m from the point before and cum_m from the start of the route."""
    w = Window.partitionBy("route_id").orderBy("seq")
    step = F.coalesce(geo.haversine(F.lag("lng").over(w), F.lag("lat").over(w), F.col("lng"), F.col("lat")), F.lit(0.0))
    return traces.withColumn("step_m", step).withColumn("cum_m", F.sum("step_m").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def resample(traces: DataFrame, metres: float = 20.0) -> DataFrame:
    """(route_id, seq, k, lng, lat): places along each step, `metres` apart at most, its end included."""
    w = Window.partitionBy("route_id").orderBy("seq")
    steps = traces.withColumn("plng", F.lag("lng").over(w)).withColumn("plat", F.lag("lat").over(w)).where("plng is not null")
    n = F.greatest(F.lit(1), F.ceil(geo.haversine(F.col("plng"), F.col("plat"), F.col("lng"), F.col("lat")) / metres)).cast("int")
    cut = steps.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    t = F.col("k") / F.col("n")
    return cut.select("route_id", "seq", "k", geo.interpolate(F.col("plng"), F.col("lng"), t).alias("lng"), geo.interpolate(F.col("plat"), F.col("lat"), t).alias("lat"))


def alike(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, like): each key with the smallest one that has the same rows (order, value). Keys' rows are compared by their SHA-256."""
    listed = F.array_sort(F.collect_list(F.struct(order, value)))
    said = graph._cut(rows.groupBy(key).agg(F.sha2(listed.cast("string"), 256).alias("said")), "alike")
    first = said.groupBy("said").agg(F.min(key).alias("like"))
    return graph._cut(said.join(first, "said").select(key, "like"), "alike")


def of_first(rows: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """The rows of those keys that stand for their group of alike()."""
    return rows.join(groups.where(F.col(key) == F.col("like")).select(key), key, "left_semi")


def for_all_alike(matches: DataFrame, routes: DataFrame, corridors: DataFrame) -> DataFrame:
    """matches (route_id, corridor_id, first_run) of those that stand for their groups, for every route and corridor of the groups."""
    met = graph._cut(matches, "group-matches").withColumnsRenamed({"route_id": "r", "corridor_id": "c"})
    met = routes.withColumnRenamed("like", "r").join(met, "r").join(corridors.withColumnRenamed("like", "c"), "c")
    return met.select("route_id", "corridor_id", "first_run")


def subsequence_matches(runs: DataFrame, corridors: DataFrame) -> DataFrame:
    """(route_id, corridor_id, first_run): places where a corridor's keys (corridor_id, pos, edge_key) are consecutive runs."""
    size = corridors.groupBy("corridor_id").agg(F.count("*").alias("size"))
    met = runs.join(corridors, "edge_key").groupBy("route_id", "corridor_id", (F.col("run") - F.col("pos")).alias("first_run")).agg(F.count("*").alias("n"))
    return met.join(size, "corridor_id").where("n = size").select("route_id", "corridor_id", "first_run")


def adjacent_matches(matches: DataFrame, runs: DataFrame, corridors: DataFrame, neighbours: DataFrame) -> DataFrame:
    """matches (route_id, corridor_id, first_run) whose runs before and after the corridor have the wanted keys.

    neighbours: corridor_id, before_key, after_key; a null key asks for nothing on that side. A match at a route's end has no run
    there, and so not the wanted one."""
    size = corridors.groupBy("corridor_id").agg(F.count("*").alias("size"))
    at = runs.select("route_id", "run", "edge_key")
    met = matches.join(size, "corridor_id").join(neighbours, "corridor_id")
    first = at.select("route_id", (F.col("run") + 1).alias("first_run"), F.col("edge_key").alias("before"))
    last = at.select("route_id", F.col("run").alias("next_run"), F.col("edge_key").alias("after"))
    met = met.join(first, ["route_id", "first_run"], "left").withColumn("next_run", F.col("first_run") + F.col("size")).join(last, ["route_id", "next_run"], "left")
    same = lambda wanted, found: F.col(wanted).isNull() | F.coalesce(F.col(wanted) == F.col(found), F.lit(False))
    return met.where(same("before_key", "before") & same("after_key", "after")).select("route_id", "corridor_id", "first_run")


def running_sums(rows: DataFrame, weight: str, order: str, group: str | None = None) -> DataFrame:
    """rows (order, unique within its group) with `upto`, the sum of `weight` up to and with each, and `total`.

    Rows are dealt by ranges of the order, whatever the groups' sizes, and summed in each part; the parts' own sums, one row for
    each part and group, are summed in turn and added. No task holds more than a part.
    """
    keys = [group] if group else []
    parts = rows.repartitionByRange(*keys, order).withColumn("__part", F.spark_partition_id())
    parts = graph._cut(parts, "running-sums")
    own = parts.groupBy("__part", *keys).agg(F.sum(weight).alias("__own"))
    before = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    base = own.select("__part", *keys, (F.sum("__own").over(before.orderBy("__part")) - F.col("__own")).alias("__base"), F.sum("__own").over(before).alias("total"))
    within = Window.partitionBy("__part", *keys).orderBy(order)
    summed = parts.withColumn("__upto", F.sum(weight).over(within)).join(base, ["__part", *keys])
    return summed.select(*rows.columns, (F.col("__upto") + F.col("__base")).alias("upto"), "total")


def nearest_rank(values: DataFrame, group: str, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(group, p50, p95, ..., max): percentiles by nearest rank, the ceil(n * p)-th smallest value of each group.

    Equal values are counted first, in the tasks too; the distinct ones are then summed by ranges of values, so that a group of
    any size is spread over tasks.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    ranked = running_sums(counts, "c", value, group)
    return ranked.groupBy(group).agg(*(F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * p), F.col(value))).alias(f"p{round(p * 100)}") for p in shares), F.max(value).alias("max"))


def sample_evenly(rows: DataFrame, order: str, most: int) -> DataFrame:
    """At most `most` rows: those at places floor(i * n / most) in the order of a unique column; all rows if there are no more (a
    sampling operator). Places come from sums by ranges, not from one sorted task."""
    placed = running_sums(rows.withColumn("__one", F.lit(1).cast("bigint")), "__one", order)
    at, n = F.col("upto") - 1, F.col("total")
    # the i that a place could be chosen by is the least with floor(i * n / most) >= place
    i = F.ceil(at * most / n)
    chosen = (n <= most) | ((i < most) & (F.floor(i * n / most) == at))
    return placed.where(chosen).select(*rows.columns)


def best_exit(candidates: DataFrame) -> DataFrame:
    """Of each request's candidates (score, dist_mm, target) the least score, then distance, then id."""
    return candidates.groupBy("request").agg(F.min(F.struct("score", "dist_mm", "target")).alias("b")).select("request", "b.target", "b.score", "b.dist_mm")


def first_and_last(crossings: DataFrame) -> DataFrame:
    """(route_id, first_portal, last_portal) by (run, seq), then id."""
    return crossings.groupBy("route_id").agg(F.min(F.struct("run", "seq", "portal_id")).alias("a"), F.max(F.struct("run", "seq", "portal_id")).alias("b")).select("route_id", F.col("a.portal_id").alias("first_portal"), F.col("b.portal_id").alias("last_portal"))


def preferred(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first by `order`."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def distinct_routes(routes: DataFrame, metres: float = 200.0, degrees: float = 1e-4) -> DataFrame:
    """Routes that aren't like an earlier kept one of their request: lengths in one band, and both ends within `degrees`.

    Likeness isn't transitive, so rows are folded in order: a request's alternatives are few.
    """
    same = lambda a, b: (F.floor(a["dist_m"] / metres) == F.floor(b["dist_m"] / metres)) & (F.abs(a["slng"] - b["slng"]) <= degrees) & (F.abs(a["slat"] - b["slat"]) <= degrees) & (F.abs(a["elng"] - b["elng"]) <= degrees) & (F.abs(a["elat"] - b["elat"]) <= degrees)
    own = F.array_sort(F.collect_list(F.struct("seq", "route", "dist_m", "slng", "slat", "elng", "elat")))
    grouped = routes.groupBy("request").agg(own.alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda kept, r: F.when(F.exists(kept, lambda k: same(k, r)), kept).otherwise(F.concat(kept, F.array(r))))
    return grouped.select("request", F.explode(kept).alias("r")).select("request", "r.*")


def tier_choice(candidates: DataFrame, accept: float) -> DataFrame:
    """(request, target, tier): the best target (score, distance, name) of the first tier that has one with a score of `accept` or
    less; a request without any takes the best of all. candidates: request, target, tier, score, dist_mm."""
    good = F.col("score") <= accept
    order = F.struct((~good).cast("int").alias("bad"), F.when(good, F.col("tier")).otherwise(0).alias("t"), "score", "dist_mm", "target")
    return candidates.groupBy("request").agg(F.min(F.struct(order.alias("o"), "tier")).alias("b")).select("request", "b.o.target", "b.tier")


def first_of_each(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each group; partial heaps in the tasks come before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
