"""Text, key and fingerprint functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_bracketed(text: Column) -> Column:
    """The last [...] of a text, trimmed; null without one."""
    found = F.regexp_extract_all(text, F.lit(r"\[([^\]\r\n]+)\]"), F.lit(1))
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


def json_token(json: Column, name: str) -> Column:
    """A top-level field's token, quotes included, so that "1" and 1 stay apart; null where it is missing or null."""
    token = F.to_json(F.try_variant_get(F.try_parse_json(json), f"$.{name}", "variant"))
    return F.when(token != "null", token)


def flag_is(token: Column, value: int) -> Column:
    """Whether a raw token is exactly the quoted digit, or a number equal to it; false for null."""
    number = F.when(~token.startswith('"'), token.try_cast("decimal(30,10)"))
    return F.coalesce((token == f'"{value}"') | (number == value), F.lit(False))


def lenient_number(json: Column, name: str) -> Column:
    """A finite double from a number or a numeric string, else null."""
    value = F.trim(F.get_json_object(json, f"$.{name}")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def filled(json: Column, name: str) -> Column:
    """A field as text; null where it is missing, null or blank."""
    value = F.get_json_object(json, f"$.{name}")
    return F.when(F.trim(value) != "", value)


def edge_of(key: Column) -> Column:
    return F.shiftright(key, 1)


def is_reverse(key: Column) -> Column:
    return key.bitwiseAND(F.lit(1)) == 1


def reversed_key(key: Column) -> Column:
    return key.bitwiseXOR(F.lit(1))


def fingerprint(ids: DataFrame, column: str, chunk: int = 4096) -> DataFrame:
    """One row, `fingerprint`: SHA-256 over the hashes of the distinct ids' chunks, in order; of each chunk (ids that `chunk` divides
    alike) the hash of its sorted ids as text with commas. No task holds more than a chunk, or the hashes of all chunks."""
    own = ids.select(F.col(column).cast("bigint").alias("id")).distinct().withColumn("chunk", F.floor(F.col("id") / chunk))
    text_of = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x.cast("string")), ",")
    chunks = own.groupBy("chunk").agg(F.sha2(text_of("id"), 256).alias("hash"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "hash"))), lambda x: x["hash"]), ",")
    return chunks.agg(F.sha2(ordered, 256).alias("fingerprint"))


def canonical_fingerprint(ids: DataFrame, column: str, label: str, most: int = 10_000_000) -> DataFrame:
    """One row, `fingerprint`: SHA-256 of the canonical text of a set of ids, ``label=1,2,3,|`` in ascending order.

    The text stands whole in one row, as its definition asks; over `most` ids are an error, and fingerprint() is the form for any
    number."""
    own = ids.select(F.col(column).cast("bigint").alias("id")).distinct()
    listed = own.agg(F.when(F.count("*") > most, F.raise_error(F.lit(f"over {most} ids")).cast("array<bigint>")).otherwise(F.array_sort(F.collect_list("id"))).alias("ids"))
    said = F.array_join(F.transform("ids", lambda x: F.concat(x.cast("string"), F.lit(","))), "")
    return listed.select(F.sha2(F.concat(F.lit(f"{label}="), said, F.lit("|")), 256).alias("fingerprint"))


def _plain(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))


# What metres, kilometres, minutes and hours are called.
DISTANCE_UNITS, DURATION_UNITS = ("米", "公里"), ("分钟", "小时")


def tenths(value: Column) -> Column:
    """A number of at least 0 and below 1e15 with one decimal, by its exact binary value: 1.65, which is stored as a little less, is
    1.6. True halves, which are odd multiples of a quarter, go up."""
    half = (value * 4 == F.floor(value * 4)) & (F.floor(value * 4) % 2 == 1)
    return F.translate(F.format_number(F.when(half, F.floor(value * 10 + 0.5) / 10).otherwise(value), 1), ",", "")


def distance_text(metres: Column, units: tuple[str, str] = DISTANCE_UNITS) -> Column:
    """Whole metres below a kilometre, tenths of kilometres below ten, then whole ones; "--" for what is no distance."""
    km, (small, large) = metres / 1000, units
    text = F.when(metres < 1000, F.concat(F.floor(metres + 0.5).cast("string"), F.lit(f" {small}"))).when(km < 10, F.concat(tenths(km), F.lit(f" {large}"))).otherwise(F.concat(F.floor(km + 0.5).cast("string"), F.lit(f" {large}")))
    return F.when(_plain(metres), text).otherwise("--")


def duration_text(seconds: Column, units: tuple[str, str] = DURATION_UNITS) -> Column:
    """Minutes, one at least, and hours from sixty on; "--" for what is no duration."""
    small, large = units
    minutes = F.greatest(F.lit(1), F.floor(seconds / 60 + 0.5)).cast("bigint")
    hours, rest = F.floor(minutes / 60).cast("string"), minutes % 60
    text = F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(f" {small}"))).when(rest == 0, F.concat(hours, F.lit(f" {large}"))).otherwise(F.concat(hours, F.lit(f" {large} "), rest.cast("string"), F.lit(f" {small}")))
    return F.when(_plain(seconds), text).otherwise("--")


def version_text(value: Column) -> Column:
    """Month, day, hour and minute of a timestamp in text form; other texts as they are."""
    return F.coalesce(F.date_format(value.try_cast("timestamp"), "MM/dd HH:mm"), value)


def appended(base: Column, value: Column) -> Column:
    """base and value side by side, or the one of them that holds the other."""
    value = F.coalesce(value, F.lit(""))
    return F.when((value == "") | F.contains(base, value), base).when(F.contains(value, base), value).otherwise(F.concat(base, value))


def described(parts: Column) -> Column:
    """The trimmed, filled texts of array<string>, appended in order without overlap."""
    return F.aggregate(parts, F.lit(""), lambda base, part: appended(base, F.trim(part)))


# What a failed plan is answered with, by its reason.
ERROR_CODES = {
    "TOPOLOGY_NOT_READY": "SIXTH_RING_TOPOLOGY_NOT_READY",
    "BOUNDARY_AMBIGUOUS": "SIXTH_RING_BOUNDARY_AMBIGUOUS",
    "POINT_NOT_FOUND": "OUTSIDE_ROUTING_BOUNDS",
    "NO_ROUTE": "NO_COMPLIANT_ROUTE",
    "SEARCH_TIMEOUT": "ROUTE_SEARCH_TIMEOUT",
    "RESOURCE_LIMIT": "ROUTE_SEARCH_RESOURCE_LIMIT",
    "REFERENCE_ROUTE_FAILED": "REFERENCE_ROUTE_FAILED",
}


def error_code(reason: Column) -> Column:
    """The code of a failure; an unknown reason counts as no route."""
    known = F.create_map(*(F.lit(x) for pair in ERROR_CODES.items() for x in pair))
    return F.when(reason.isNotNull(), F.coalesce(F.try_element_at(known, reason), F.lit(ERROR_CODES["NO_ROUTE"])))


def file_hash(content: Column) -> Column:
    """SHA-256 of bytes, as read by the binaryFile source."""
    return F.sha2(content, 256)


def handover_uri(outbound: Column, handover: Column, end: Column, base: str, names: tuple[str, str, str] = ("inner handover", "outer start", "outer end")) -> Column:
    """A link of the navigation service at `base` between the handover and a route's outer end, struct<lng, lat> each: from the handover if outbound."""
    at = lambda p, name: F.concat(p["lng"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit(","), name)
    inner, start, stop = map(F.lit, names)
    first, last = F.when(outbound, at(handover, inner)).otherwise(at(end, start)), F.when(outbound, at(end, stop)).otherwise(at(handover, inner))
    return F.concat(F.lit(base + "?from="), F.url_encode(first), F.lit("&to="), F.url_encode(last), F.lit("&mode=car&policy=0&callnative=1"))


def navigation_uri(lng: Column, lat: Column, name: Column, base: str) -> Column:
    return F.concat(F.lit(base + "?to="), F.format_string("%.6f,%.6f", lng, lat), F.lit(","), F.url_encode(name))
