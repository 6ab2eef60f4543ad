"""Graph operators: components, bounded reach, edge-keyed shortest paths with turn bans, simple paths."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession, name: str) -> str:
    """A new name in the folder that driver and executors share: `spark.checkpoint.dir`; in local mode, where that may be unset, one
    of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="wayfold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder that executors share and read back, which ends its lineage."""
    spark = df.sparkSession
    path = shared(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wayfold_path = path
    return out


def _drop(df: DataFrame) -> None:
    """Deletes a table that _cut() wrote, once nothing reads it any more."""
    context = df.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(df._wayfold_path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that undirected links (a, b) reach.

    Each round gives every node the least label among its own and its neighbours', then that label's label (pointer jumping);
    map-side minima keep nodes with many links cheap.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = _cut(both, "component-links")
    labels = _cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "component-labels")
    before = labels
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("least"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "least").alias("label"), F.col("label").alias("was"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = _cut(step.join(jump, "label", "left").select("node", F.least("label", "far").alias("label"), "was"), "component-labels")
        changed = after.where("label <> was").limit(1).count()
        _drop(before)
        before, labels = after, after.drop("was")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def cycles(links: DataFrame, *order: str) -> DataFrame:
    """(node, first, seq): each node of the cycles that links (node, next, and the columns of `order`) make, a node having one next
    and one before: the cycle's least node by `order`, then by its number, and how many steps from there the node lies.

    Each round knows of every node the least one of twice as many steps on and how far it is; when a round changes nothing, all
    know the cycle's. Rounds are as the logarithm of the longest cycle, each a join of rows by node, so no cycle is held by a task.
    """
    own = F.struct(*order, "node")
    known = _cut(links.select("node", own.alias("least"), F.lit(0).cast("bigint").alias("ahead"), F.col("next").alias("to"), F.lit(True).alias("new")), "cycles")
    reach = 1
    while not known.where("new").isEmpty():
        on = known.select(F.col("node").alias("to"), F.col("least").alias("l"), F.col("ahead").alias("a"), F.col("to").alias("beyond"))
        less = F.col("l") < F.col("least")
        after = known.join(on, "to").select("node", F.least("least", "l").alias("least"), F.when(less, F.col("a") + reach).otherwise(F.col("ahead")).alias("ahead"), F.col("beyond").alias("to"), less.alias("new"))
        after = _cut(after, "cycles")
        _drop(known)
        known, reach = after, 2 * reach
    # the node after the first one has the longest way ahead
    size = known.groupBy("least").agg((F.max("ahead") + 1).alias("size"))
    return known.join(size, "least").select("node", F.col("least.node").alias("first"), F.when(F.col("ahead") == 0, 0).otherwise(F.col("size") - F.col("ahead")).alias("seq"))


def adjacency(edge_keys: DataFrame, forbidden: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(key, next_key, next_mm): legal turns between directed edge keys; turns banned by edge and node, and blocked keys, are left out."""
    keys = edge_keys if blocked is None else edge_keys.join(blocked.select("key").distinct(), "key", "left_anti")
    a = keys.select("key", F.col("edge_id").alias("from_edge"), F.col("to_node").alias("via_node"))
    b = keys.select(F.col("key").alias("next_key"), F.col("edge_id").alias("to_edge"), F.col("from_node").alias("via_node"), F.col("len_mm").alias("next_mm"))
    return a.join(b, "via_node").join(forbidden, ["from_edge", "via_node", "to_edge"], "left_anti").select("key", "next_key", "next_mm")


def shortest_paths(seeds: DataFrame, turns: DataFrame, limit: int | None = None, small: int = 2_000_000, **far) -> DataFrame:
    """(request, key, dist_mm, ms, pred): the cheapest way to the end of each directed edge key that each request reaches.

    seeds: (request, key, dist_mm, ms if any), turns: (key, next_key, next_mm, next_ms if any). Cost is distance, then time (0
    where a table has none), and of equal ways the smaller predecessor stands (-1 for a seed). State is the directed key, so
    turn bans hold. Keys over `limit` millimetres are left out, seeds too. turns of `small` rows or fewer (counted first) go to
    every task as arrays of about 30 bytes a turn, 60 MB at most, where each request is solved alone by a heap, however many
    there are; larger networks are searched in parts: with a limit by requests (search.near_parts()), else, and where that has no
    answer, in rounds, see search.far_labels(), which takes `far`. All give the same rows.
    """
    from wayfold.operators import search

    turns = _cut(search.prepared(turns), "turns")  # read twice: to be counted, and to be joined or sent
    seeds = search.starts(seeds)
    if turns.limit(small + 1).count() > small:
        return search.far_labels(seeds, turns, limit, **far)[0] if limit is None else search.within(seeds, turns, limit, **far)
    return search.near_labels(seeds, turns, limit)


def traced(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """(request, key): all keys on the ways that paths (request, key, pred) has to ends (request, key), ends included.

    Predecessors are followed for all requests at once; a key that several ways share is followed once.
    """
    front = _cut(ends.select("request", "key").distinct(), "traced")
    seen = front
    while True:
        back = paths.join(front, ["request", "key"], "left_semi").where("pred >= 0").select("request", F.col("pred").alias("key")).distinct()
        front = _cut(back.join(seen, ["request", "key"], "left_anti"), "traced")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def node_reach(seeds: DataFrame, links: DataFrame, limit: int) -> DataFrame:
    """(request, node, dist_mm): nodes within `limit` millimetres of seeds (request, node) over undirected links (u, v, len_mm)."""
    ways = links.select(F.col("u").alias("key"), F.col("v").alias("next_key"), F.col("len_mm").alias("next_mm")).unionByName(links.select(F.col("v").alias("key"), F.col("u").alias("next_key"), F.col("len_mm").alias("next_mm")))
    found = shortest_paths(seeds.select("request", F.col("node").alias("key"), F.lit(0).alias("dist_mm")), ways, limit)
    return found.select("request", F.col("key").alias("node"), "dist_mm")


def tiered_targets(paths: DataFrame, targets: DataFrame, lengths: DataFrame, tolerance_mm: int) -> DataFrame:
    """(request, target, dist_mm, tier): targets (target, key, fraction) within `tolerance_mm` of each request's best one.

    A target lies on a key's edge: it costs the way to the edge's start and its fraction of the edge. tier 1 is up to a
    kilometre beyond the best.
    """
    cost = (F.col("dist_mm") - F.col("len_mm") + F.floor(F.col("len_mm") * F.col("fraction"))).cast("bigint")
    met = paths.join(targets, "key").join(lengths.select("key", "len_mm"), "key").groupBy("request", "target").agg(F.min(cost).alias("dist_mm"))
    best = met.groupBy("request").agg(F.min("dist_mm").alias("best"))
    near = met.join(best, "request").where(F.col("dist_mm") <= F.col("best") + tolerance_mm)
    return near.select("request", "target", "dist_mm", F.greatest(F.lit(1), F.ceil((F.col("dist_mm") - F.col("best")) / 1_000_000)).cast("int").alias("tier"))


def simple_paths(starts: DataFrame, links: DataFrame, limit: int, hops: int | None = None) -> DataFrame:
    """(start, path array<bigint>, dist_mm): ways without a repeated node over links (u, v, len_mm), both directions, up to
    `limit` millimetres (and `hops` links, if given); grown hop by hop as joins, until no way grows."""
    ways = links.select("u", "v", "len_mm").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "len_mm"))
    grown = starts.select(F.col("node").alias("start"), F.array("node").alias("path"), F.lit(0).cast("bigint").alias("dist_mm"))
    found, n = None, 0
    while hops is None or n < hops:
        grown = grown.withColumn("u", F.element_at("path", -1)).join(ways, "u").where(~F.array_contains("path", F.col("v")) & (F.col("dist_mm") + F.col("len_mm") <= limit))
        grown = _cut(grown.select("start", F.concat("path", F.array("v")).alias("path"), (F.col("dist_mm") + F.col("len_mm")).alias("dist_mm")), "simple-paths")
        found = grown if found is None else found.unionByName(grown)
        if grown.isEmpty():
            break
        n += 1
    return found
