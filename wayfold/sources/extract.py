"""Binary map extracts as a Spark data source: a partition for each blob, decoded where it is read."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayfold.operators import blocks

# Fixed values of the format: what a reader must know of a file, and the most bytes of a header and of a blob.
FEATURES = ("OsmSchema-V0.6", "DenseNodes")
MOST_HEADER, MOST_BLOB = 64 << 10, 32 << 20
MEMBER_TYPES = ("node", "way", "relation")
SCHEMA = "kind string, id bigint, lng double, lat double, tags map<string,string>, refs array<bigint>, members array<struct<type: string, ref: bigint>>"
_ARROW = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("lng", pa.float64()), ("lat", pa.float64()), ("tags", pa.map_(pa.string(), pa.string())), ("refs", pa.list_(pa.int64())), ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64())])))])


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: integers as they stand, the others as bytes."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = raw[at : at + size], at + size
        else:
            raise ValueError(f"unknown kind of field {kind}")
        yield number, value


def packed(raw: bytes) -> np.ndarray:
    """All numbers of a packed field, unsigned."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    for k in range(int((ends - starts).max(initial=-1)) + 1):
        has = starts + k <= ends
        out[has] |= (b[starts[has] + k] & np.uint64(127)) << np.uint64(7 * k)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """Zigzag numbers, with their sign."""
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def _of(raw: bytes) -> dict[int, list]:
    found: dict[int, list] = {}
    for number, value in fields(raw):
        found.setdefault(number, []).append(value)
    return found


def _joined(found: dict[int, list], number: int) -> bytes:
    return b"".join(found.get(number, []))


def blob(raw: bytes) -> bytes:
    """What a blob holds, as it stands or from zlib; other compressions are refused."""
    found = _of(raw)
    if 1 in found:
        return found[1][0]
    if 3 not in found:
        raise ValueError("a blob's compression isn't known")
    return zlib.decompress(found[3][0])


def elements(raw: bytes) -> list[dict]:
    """Rows of SCHEMA of a block of elements."""
    block = _of(raw)
    texts = [x.decode() for x in _of(block[1][0]).get(1, [])]
    grain, lat0, lng0 = (block.get(k, [d])[0] for k, d in ((17, 100), (19, 0), (20, 0)))
    lat0, lng0 = (x - (1 << 64) if x >> 63 else x for x in (lat0, lng0))
    degrees = lambda x, off: (off + grain * x) / 1e9
    tags = lambda m: [(texts[k], texts[v]) for k, v in zip(packed(_joined(m, 2)).tolist(), packed(_joined(m, 3)).tolist(), strict=True)]
    zigzag = lambda x: (x >> 1) ^ -(x & 1)
    rows: list[dict] = []
    for group in map(_of, block.get(2, [])):
        for m in map(_of, group.get(1, [])):
            rows.append({"kind": "node", "id": zigzag(m[1][0]), "lat": degrees(zigzag(m[8][0]), lat0), "lng": degrees(zigzag(m[9][0]), lng0), "tags": tags(m)})
        for m in map(_of, group.get(2, [])):
            ids, lat, lng = (np.cumsum(signed(packed(_joined(m, k)))) for k in (1, 8, 9))
            own: list[list[tuple[str, str]]] = [[]]
            pairs = iter(packed(_joined(m, 10)).tolist())
            for k in pairs:
                if k:
                    own[-1].append((texts[k], texts[next(pairs)]))
                else:
                    own.append([])
            own += [[]] * (len(ids) - len(own))
            rows += [{"kind": "node", "id": i, "lat": a, "lng": b, "tags": t} for i, a, b, t in zip(ids.tolist(), degrees(lat, lat0).tolist(), degrees(lng, lng0).tolist(), own, strict=False)]
        for m in map(_of, group.get(3, [])):
            rows.append({"kind": "way", "id": m[1][0], "tags": tags(m), "refs": np.cumsum(signed(packed(_joined(m, 8)))).tolist()})
        for m in map(_of, group.get(4, [])):
            refs, kinds = np.cumsum(signed(packed(_joined(m, 9)))).tolist(), packed(_joined(m, 10)).tolist()
            rows.append({"kind": "relation", "id": m[1][0], "tags": tags(m), "members": [{"type": MEMBER_TYPES[k], "ref": r} for k, r in zip(kinds, refs, strict=True)]})
    return rows


@dataclass
class _Blob(InputPartition):
    at: int
    size: int


class _Reader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[_Blob]:
        """The blobs of elements; only their headers are read here."""
        fs, path = blocks.at(self.uri)
        found, at = [], 0
        with fs.open_input_file(path) as f:
            end = f.size()
            while at < end:
                f.seek(at)
                size = struct.unpack(">i", f.read(4))[0]
                if not 0 < size <= MOST_HEADER:
                    raise ValueError(f"no blob header at byte {at}")
                head = _of(f.read(size))
                own = _Blob(at + 4 + size, head[3][0])
                if own.size > MOST_BLOB or own.at + own.size > end:
                    raise ValueError(f"the blob at byte {at} is cut off or too large")
                if head[1][0] == b"OSMHeader":
                    f.seek(own.at)
                    unknown = [x.decode() for x in _of(blob(f.read(own.size))).get(4, []) if x.decode() not in FEATURES]
                    if unknown:
                        raise ValueError(f"the file needs features that aren't known: {unknown}")
                elif head[1][0] == b"OSMData":
                    found.append(own)
                at = own.at + own.size
        return found

    def read(self, partition: _Blob) -> Iterator[pa.RecordBatch]:
        fs, path = blocks.at(self.uri)
        with fs.open_input_file(path) as f:
            f.seek(partition.at)
            rows = elements(blob(f.read(partition.size)))
        for i in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_pylist(rows[i : i + 4096], _ARROW)


class MapExtract(DataSource):
    """format("map_extract"): the elements of a binary map extract at `path`, as rows of SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "map_extract"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def read_binary_extract(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes, ways and relations of a binary map extract, as landing.read_extract() gives them of one in XML.

    A task decodes one blob of at most 32 MB; a file that is cut off, or that needs features or compressions that aren't known, is an
    error. Executors must reach the path."""
    blocks.ship(spark)
    spark.dataSource.register(MapExtract)
    rows = spark.read.format("map_extract").load(path)
    of = lambda kind: rows.where(F.col("kind") == kind)
    none = F.array().cast("array<bigint>")
    own_ways = F.transform(F.filter("members", lambda m: m["type"] == "way"), lambda m: m["ref"])
    return {
        "nodes": of("node").select(F.col("id").alias("node_id"), "lng", "lat", "tags"),
        "ways": of("way").select(F.col("id").alias("way_id"), F.coalesce("refs", none).alias("nodes"), "tags"),
        "relations": of("relation").select(F.col("id").alias("relation_id"), F.coalesce(own_ways, none).alias("ways"), "tags"),
    }
