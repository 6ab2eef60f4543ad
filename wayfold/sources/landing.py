"""Files as they land: point downloads, map extracts, line and area features, and the hashes beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def landed(spark: SparkSession, path: str, most_bytes: int = 64 << 20) -> DataFrame:
    """(path, modified, bytes, sha256, problem) of the files under a landing folder: a download that is too large or no JSON
    document (only white space, too) names its problem, others have null. Files without a byte are passed over by the reader."""
    files = spark.read.format("binaryFile").load(path)
    small = F.when(F.col("length") <= most_bytes, F.col("content"))
    problem = F.when(F.col("length") > most_bytes, "too large").when(F.try_parse_json(small.cast("string")).isNull(), "no JSON")
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), F.when(problem.isNull(), F.sha2(small, 256)).alias("sha256"), problem.alias("problem"))


def verified(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """files (path, sha256, ...) with `verdict` from hash files beside them (path ending in .sha256, value): MISSING without one,
    MALFORMED if it isn't 64 hexadecimal digits, MISMATCH or OK."""
    side = sidecars.select(F.regexp_replace("path", r"\.sha256$", "").alias("path"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("wanted"))
    verdict = F.when(F.col("wanted").isNull(), "MISSING").when(~F.col("wanted").rlike("^[0-9a-fA-F]{64}$"), "MALFORMED").when(F.lower("wanted") != F.col("sha256"), "MISMATCH").otherwise("OK")
    return files.join(side, "path", "left").withColumn("verdict", verdict).drop("wanted")


def only_verified(files: DataFrame) -> DataFrame:
    """files as of verified(), whose every row must be OK: reading one that isn't is an error that stops the job."""
    bad = F.raise_error(F.concat("path", F.lit(": "), "verdict")).cast("string")
    return files.withColumn("verdict", F.when(F.col("verdict") == "OK", F.col("verdict")).otherwise(bad))


def _tags(tag: Column) -> Column:
    return F.map_from_entries(F.transform(F.coalesce(tag, F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"], t["_v"])))


def read_extract(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes (node_id, lng, lat, tags), ways (way_id, nodes, tags) and relations (relation_id, ways, tags) of a map extract in
    XML. Elements are split by the XML reader, so that a large file is read in parallel where its format can be split."""
    tag = "tag array<struct<_k: string, _v: string>>"

    def rows(name: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", name).schema(f"_id bigint, {tag}, {schema}").load(path)

    nodes = rows("node", "_lon double, _lat double").select(F.col("_id").alias("node_id"), F.col("_lon").alias("lng"), F.col("_lat").alias("lat"), _tags(F.col("tag")).alias("tags"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    ways = rows("way", "nd array<struct<_ref: bigint>>").select(F.col("_id").alias("way_id"), none(F.col("nd._ref"), "array<bigint>").alias("nodes"), _tags(F.col("tag")).alias("tags"))
    members = F.filter("member", lambda m: m["_type"] == "way")
    relations = rows("relation", "member array<struct<_type: string, _ref: bigint, _role: string>>").select(F.col("_id").alias("relation_id"), none(F.transform(members, lambda m: m["_ref"]), "array<bigint>").alias("ways"), _tags(F.col("tag")).alias("tags"))
    return {"nodes": nodes, "ways": ways, "relations": relations}


def network_of(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(edge_id, way_id, u, v, places, road_class, car_access, one_way): an edge for each pair of consecutive nodes of a way with a
    `highway` tag. Edges are numbered by way and place in it, so that the same extract gives the same numbers."""
    roads = ways.where("tags['highway'] is not null")
    pairs = roads.select("way_id", "tags", F.posexplode(F.zip_with(F.slice("nodes", F.lit(1), F.greatest(F.size("nodes") - 1, F.lit(0))), F.slice("nodes", F.lit(2), F.greatest(F.size("nodes") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("u"), b.alias("v")))).alias("pos", "p"))
    at = lambda c: nodes.select(F.col("node_id").alias(c), F.col("lng").alias(f"{c}lng"), F.col("lat").alias(f"{c}lat"))
    met = pairs.select("way_id", "pos", "p.u", "p.v", "tags").join(at("u"), "u").join(at("v"), "v")
    shut = F.coalesce(F.col("tags")["access"].isin("no", "private") | F.col("tags")["motor_vehicle"].isin("no"), F.lit(False))
    return met.select((F.col("way_id") * 65_536 + F.col("pos")).alias("edge_id"), "way_id", "u", "v", "ulng", "ulat", "vlng", "vlat", F.col("tags")["highway"].alias("road_class"), (~shut).alias("car_access"), F.coalesce(F.col("tags")["oneway"] == "yes", F.lit(False)).alias("one_way"))


def toll_booths(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(node_id, lng, lat, ways): nodes tagged as toll booths, with the ids of the ways through them, sorted; [] without any."""
    own = ways.select(F.col("way_id"), F.explode("nodes").alias("node_id")).groupBy("node_id").agg(F.array_sort(F.collect_set("way_id")).alias("ways"))
    booths = nodes.where("tags['barrier'] = 'toll_booth'").select("node_id", "lng", "lat")
    return booths.join(own, "node_id", "left").withColumn("ways", F.coalesce("ways", F.array().cast("array<bigint>")))


def within_box(nodes: DataFrame, ways: DataFrame, box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of an extract cut to (min_lng, min_lat, max_lng, max_lat): ways with a node inside, and all of their nodes."""
    a, b, c, d = box
    inside = nodes.where(F.col("lng").between(a, c) & F.col("lat").between(b, d)).select("node_id")
    refs = ways.select("way_id", F.explode("nodes").alias("node_id"))
    kept = refs.join(inside, "node_id", "left_semi").select("way_id").distinct()
    wanted = refs.join(kept, "way_id", "left_semi").select("node_id").union(inside).distinct()
    return nodes.join(wanted, "node_id", "left_semi"), ways.join(kept, "way_id", "left_semi")


def features(spark: SparkSession, path: str) -> DataFrame:
    """(kind, tags, coordinates as JSON) of a GeoJSON file's features."""
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return rows.select(F.col("f.geometry.type").alias("kind"), F.coalesce("f.properties", F.create_map().cast("map<string,string>")).alias("tags"), "f.geometry.coordinates")


def line_segments(found: DataFrame, tags: dict[str, str] | None = None) -> DataFrame:
    """(ax, ay, bx, by) of the LineString features with all the given tags."""
    for k, v in (tags or {}).items():
        found = found.where(F.col("tags")[k] == v)
    points = found.where("kind = 'LineString'").select(F.from_json("coordinates", "array<array<double>>").alias("p"))
    n = F.greatest(F.size("p") - 1, F.lit(0))
    steps = points.select(F.explode(F.zip_with(F.slice("p", F.lit(1), n), F.slice("p", F.lit(2), n), lambda a, b: F.struct(F.get(a, F.lit(0)).alias("ax"), F.get(a, F.lit(1)).alias("ay"), F.get(b, F.lit(0)).alias("bx"), F.get(b, F.lit(1)).alias("by")))).alias("s"))
    return steps.select("s.*")


def area_rings(found: DataFrame, tags: dict[str, str]) -> DataFrame:
    """(ring, seq, lng, lat) of the Polygon features with all the given tags."""
    for k, v in tags.items():
        found = found.where(F.col("tags")[k] == v)
    rings = found.where("kind = 'Polygon'").select(F.posexplode(F.from_json("coordinates", "array<array<array<double>>>")).alias("ring", "p"))
    return rings.select("ring", F.posexplode("p").alias("seq", "p")).select("ring", "seq", F.get("p", F.lit(0)).alias("lng"), F.get("p", F.lit(1)).alias("lat"))
