"""Validated ingestion of restricted points from JSON records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geo, text


@dataclass
class Ingested:
    """valid: good points; issues: (record_index, id, reason) of bad records; metrics: one row of counters."""

    valid: DataFrame
    issues: DataFrame
    metrics: DataFrame


# Names of the field that may hold the records, in any case.
WRAPPERS = ("data", "items", "result", "cameras", "records")


def read_point_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_index, json) of a file that holds an array of records, or an object with such an array in a field named as in
    WRAPPERS, the first of them in the document's order; anything else is an error.

    A single JSON document is one value: it is split by the JSON reader, as a variant, not by text.
    """
    return split_records(spark.read.text(path, wholetext=True))


def split_records(documents: DataFrame) -> DataFrame:
    """(record_index, json) of JSON documents (value), see read_point_records()."""
    whole = documents.select("value", F.parse_json("value").alias("v"))
    array = lambda v: F.schema_of_variant(v).startswith("ARRAY")
    fields = F.from_json("value", "map<string,string>")
    names = F.filter(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), lambda k: F.lower(k).isin(*WRAPPERS))
    inner = F.filter(F.transform(names, lambda k: F.try_parse_json(F.element_at(fields, k))), lambda v: v.isNotNull() & array(v))
    none = F.raise_error(F.lit("point JSON must be an array or an object that wraps one")).cast("variant")
    found = whole.select(F.when(array(F.col("v")), F.col("v")).when(F.size(inner) > 0, F.get(inner, F.lit(0))).otherwise(none).alias("v"))
    rows = found.select(F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("record_index", "r"))
    return rows.select(F.col("record_index").cast("bigint"), F.to_json("r").alias("json"))


def ingest_points(records: DataFrame, flag_field: str = "IsSixRingOut", kind_field: str = "CameraType") -> Ingested:
    """Checks records (record_index, json).

    Records whose `flag_field` is 1 are left out; unknown and missing flags stay and are counted. A record's first failing
    check is its reason. Of records with one id the first stands, even if it fails a later check. A null json is no object.
    """
    flag = text.json_token(F.col("json"), flag_field)
    kept = records.withColumn("out", text.flag_is(flag, 1)).withColumn("known", text.flag_is(flag, 0))
    parsed = kept.where("not out").select(
        "record_index",
        "known",
        F.coalesce(F.schema_of_variant(F.try_parse_json("json")).startswith("OBJECT"), F.lit(False)).alias("is_object"),
        text.filled(F.col("json"), "Id").alias("id"),
        F.coalesce(F.get_json_object("json", "$.District"), F.lit("")).alias("district"),
        text.lenient_number(F.col("json"), "Lng").alias("lng"),
        text.lenient_number(F.col("json"), "Lat").alias("lat"),
        text.filled(F.col("json"), "Address").alias("address"),
        text.filled(F.col("json"), kind_field).alias("kind"),
    )
    named = F.col("is_object") & F.col("id").isNotNull()
    # ids spread the window; a group is the repeats of one id (rows without one are spread by their index)
    group = F.when(named, F.col("id"))
    first = F.min("record_index").over(Window.partitionBy(F.coalesce(group, F.concat(F.lit("#"), F.col("record_index").cast("string"))), group.isNull()))
    reason = (
        F.when(~F.col("is_object"), "not an object")
        .when(F.col("id").isNull(), "missing id")
        .when(F.col("record_index") > first, "duplicate id")
        .when(F.col("lng").isNull(), "bad lng")
        .when(F.col("lat").isNull(), "bad lat")
        .when(~geo.valid_coordinate(F.col("lng"), F.col("lat")), "out of range")
        .when(F.col("address").isNull(), "missing address")
        .when(F.col("kind").isNull(), "missing type")
    )
    checked = parsed.withColumn("reason", reason)
    wgs84 = geo.to_wgs84(F.col("lng"), F.col("lat"))
    valid = checked.where("reason is null").select("record_index", "id", "district", "lng", "lat", wgs84.alias("wgs84"), "address", "kind", text.last_bracketed(F.col("address")).alias("direction"))
    issues = checked.where("reason is not null").select("record_index", F.when(F.col("is_object"), F.col("id")).alias("id"), "reason")
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0)).cast("bigint")
    source = kept.agg(F.count("*").alias("source_count"), n(F.col("out")).alias("excluded_count"), n(~F.col("out")).alias("retained_count"), n(~F.col("out") & ~F.col("known")).alias("unrecognized_count"))
    good = checked.agg(n(F.col("reason").isNull()).alias("valid_count"), n(F.col("reason").isNotNull()).alias("issue_count"))
    return Ingested(valid, issues, source.join(good))


# The roles of a boundary file, and from which schema version each must be there.
ROLES = {"controlled_area": 2, "tongzhou_area": 2, "sixth_ring_area": 3, "provincial_border": 4}
LEGACY_ROLE = "inside_boundary"


def boundary_problems(spark: SparkSession, path: str, source_sha256: str, approved: bool = True) -> DataFrame:
    """(problem): why a boundary file can't be used with the network of a source: its type, coordinate system, hash, approval and
    roles. Up to schema version 1 the legacy role stands for the area."""
    head = "type string, coordinateSystem string, sourcePbfSha256 string, approvedForProduction boolean, schemaVersion int, features array<struct<properties: struct<role: string>>>"
    version, roles = F.coalesce("schemaVersion", F.lit(1)), F.coalesce(F.transform("features", lambda f: f["properties"]["role"]), F.array().cast("array<string>"))
    lacks = lambda role: ~F.array_contains(roles, role)
    rules = [
        (~F.coalesce(F.col("type") == "FeatureCollection", F.lit(False)), "no feature collection"),
        (~F.coalesce(F.col("coordinateSystem") == "WGS84", F.lit(False)), "coordinate system is not WGS84"),
        (~F.coalesce(F.col("sourcePbfSha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "no hash of the source"),
        (F.lower("sourcePbfSha256") != source_sha256.lower(), "made from another source"),
        (F.lit(approved) & ~F.coalesce("approvedForProduction", F.lit(False)), "not approved"),
        (lacks("controlled_area") & lacks(LEGACY_ROLE), "no controlled_area"),
        *(((version >= since) & lacks(role), f"no {role}") for role, since in ROLES.items() if role != "controlled_area"),
    ]
    found = F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(text)) for bad, text in rules))
    return spark.read.schema(head).json(path, multiLine=True).select(F.explode(F.array_compact(found)).alias("problem"))


def read_boundary(spark: SparkSession, path: str, source_sha256: str | None = None, approved: bool = True) -> DataFrame:
    """(role, polygon, ring, seq, lng, lat) of a GeoJSON FeatureCollection; a role that stands twice is an error.

    With the hash of the network's source the file must be made for it, approved (if asked) and whole: see boundary_problems()."""
    if source_sha256 is not None and (bad := boundary_problems(spark, path, source_sha256, approved).take(1)):
        raise ValueError(f"{path}: {bad[0]['problem']}")
    schema = "features array<struct<properties: struct<role: string>, geometry: struct<type: string, coordinates: string>>>"
    features = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    shapes = features.select(F.col("f.properties.role").alias("role"), F.when(F.col("f.geometry.type") == "MultiPolygon", many).otherwise(F.array(one)).alias("polygons"))
    n = F.count("*").over(Window.partitionBy("role"))
    checked = shapes.withColumn("role", F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate role "), F.col("role"))).cast("string")).otherwise(F.col("role")))
    rings = checked.select("role", F.posexplode("polygons").alias("polygon", "rings")).select("role", "polygon", F.posexplode("rings").alias("ring", "points"))
    at = rings.select("role", "polygon", "ring", F.posexplode("points").alias("seq", "p"))
    return at.select("role", "polygon", "ring", "seq", F.get("p", F.lit(0)).alias("lng"), F.get("p", F.lit(1)).alias("lat"))
