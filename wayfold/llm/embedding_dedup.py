"""Near-duplicate embeddings: Euclidean p-stable hashing, then exact cosines."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, persisted
from .simhash import grouped, least_ids


def _unit(raw: list[bytes]) -> np.ndarray:
    """Rows of doubles of length 1 from little-endian floats or doubles (as the first byte of each says) of one size."""
    kind = "<f8" if raw[0][0] == DOUBLE else "<f4"
    flat = np.frombuffer(b"".join(x[1:] for x in raw), kind).reshape(len(raw), -1).astype(np.float64)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # neither squares too small nor too great
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


FLOAT, DOUBLE = 4, 8


class Hasher:
    """`tables` tables of `width`-long floors of (a . x + b) / `bucket`, a normal and b uniform; drawn from `seed` and the dimension."""

    def __init__(self, tables: int, width: int, bucket: float, seed: int):
        self.tables, self.width, self.bucket, self.seed = tables, width, bucket, seed
        self.drawn: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def keys(self, unit: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """(rows, tables) unsigned 64-bit keys; salt tells labels apart."""
        dim = unit.shape[1]
        if dim not in self.drawn:
            rng = np.random.default_rng([self.seed, dim])
            a = rng.standard_normal((dim, self.tables * self.width))
            b = rng.uniform(0, self.bucket, self.tables * self.width)
            self.drawn[dim] = a, b, rng.integers(1, 1 << 63, (self.tables, self.width), np.uint64) | np.uint64(1)
        a, b, odd = self.drawn[dim]
        cells = np.floor((unit @ a + b) / self.bucket).astype(np.int64).view(np.uint64).reshape(len(unit), self.tables, self.width)
        mixed = (cells * odd).sum(axis=2, dtype=np.uint64) ^ (salt.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed ^ (mixed >> np.uint64(29))) + np.arange(self.tables, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)


def usable_vectors(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label as text, vec): vec is the width of its numbers and the vector as little-endian floats (array<float>) or doubles
    (any other array of numbers), null where it takes no part (null, empty, zero, a null or non-finite component, null label
    or id)."""
    single = rows.schema[vec_col].dataType.simpleString() == "array<float>"
    kind, mark = ("<f4", bytes([FLOAT])) if single else ("<f8", bytes([DOUBLE]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, bad = batch.column("vec"), (batch.column("label").is_null().to_numpy(zero_copy_only=False) | batch.column("id").is_null().to_numpy(zero_copy_only=False))
            flat = vectors.flatten()
            values = np.asarray(flat.fill_null(np.nan), kind) if len(flat) else np.zeros(0, kind)
            sizes = np.diff(np.concatenate([[0], np.cumsum([0 if x is None else x for x in vectors.value_lengths().to_pylist()])])).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            packed = []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                own = values[a:b]
                packed.append(None if bad[i] or not len(own) or not np.isfinite(own).all() or not own.any() else mark + own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(packed, pa.binary())], ["id", "label", "vec"])

    picked = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("vec"))
    return picked.mapInArrow(pack, "id bigint, label string, vec binary")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, tables: int = 40, width: int = 10, bucket: float = 1.0, block: int = 1024, seed: int = 7) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row.

    Rows of one label link at a cosine of `cosine` or more. Equal vectors are one class with a count; classes meet where they
    share a bucket of a table; buckets over `block` members are dealt into pairs of blocks, so that no bucket is capped and no
    task holds more than two blocks. A pair is checked exactly, in doubles, and counted in the first table where it meets; of
    each block only sums of links and a spanning forest leave. At the defaults a pair of cosine 0.98 shares no bucket with a
    probability under 0.001, a closer one still more rarely. Labels of any type count by their text form. A bucket that a great
    many unlike vectors share costs as many pairs of blocks, each a task's work of its own. Rows without a usable vector, label
    or id have no links and are their own component (null for a null id); repeated ids keep their rows, each in its own vector's
    component; ids cast to bigint (one that can't fails the job); other columns are not read, whatever their names; an empty
    table gives an empty result.
    """
    packed = persisted(usable_vectors(rows, id_col, vec_col, label_col), "vectors")
    classes = packed.where("vec is not null").groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("n"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(tables, width, bucket, seed)
        for batch in batches:
            raw = batch.column("vec").to_pylist()
            label = np.array([zlib.crc32(x.encode()) for x in batch.column("label").to_pylist()], np.int64)
            keys = np.zeros((len(raw), tables), np.uint64)
            sizes = np.array(list(map(len, raw)), np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                keys[at] = hasher.keys(_unit([raw[i] for i in at]), label[at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))], [*batch.schema.names, "keys"])

    # classes are told apart by numbers given once and read back ever after, not by ids, which may repeat
    known = classes.select("label", "vec", "rep", "n").mapInArrow(hashed, "label string, vec binary, rep bigint, n bigint, keys array<bigint>")
    known = persisted(known.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    met = known.select("class", F.posexplode("keys").alias("t", "key"))
    often = met.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    met = met.join(often, "key").withColumn("own", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("own", x).alias("p"), F.greatest("own", x).alias("q")))
    met = met.join(known, "class").select("key", "t", "own", "class", "n", "vec", "keys", "label", F.explode(pairs).alias("pq"))
    met = met.select("key", "pq.p", "pq.q", "t", "own", "class", "n", "vec", "keys", "label")
    dealt = met.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ("key", "p", "q")):
            sizes = np.array(list(map(len, group["vec"])))
            keep = (group["label"] == group["label"][0]) & (sizes == sizes[0]) & (group["t"] == group["t"][0])
            if not keep.all():  # keys that agree by chance
                parts = {}
                for i, k in enumerate(zip(group["label"].tolist(), sizes.tolist(), group["t"].tolist(), strict=True)):
                    parts.setdefault(k, []).append(i)
                groups = [{n: x[at] for n, x in group.items()} for at in parts.values()]
            else:
                groups = [group]
            for own in groups:
                if (found := _links(own)) is not None:
                    yield found

    def _links(group: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        n = len(group["class"])
        if n < 2:
            return None
        unit = _unit(list(group["vec"]))
        near = unit @ unit.T >= cosine
        np.fill_diagonal(near, False)
        if group["p"][0] != group["q"][0]:
            side = group["own"] == group["p"][0]
            near &= side[:, None] != side[None, :]
        keys = np.stack(group["keys"])
        for t in range(int(group["t"][0])):
            if not near.any():
                return None
            near &= keys[:, t, None] != keys[None, :, t]
        if not near.any():
            return None
        root = np.arange(n)
        while True:
            least = np.minimum(root, np.where(near, root[None, :], n).min(axis=1))
            least = np.minimum(least, least[least])
            if (least == root).all():
                break
            root = least
        at = np.flatnonzero(near.any(axis=1))
        links = near[at] @ group["n"].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(group["class"][at]), pa.array(links), pa.array(group["class"][root[at]])], ["class", "links", "b"])

    found = persisted(dealt.mapInArrow(linked, "class bigint, links bigint, b bigint"), "vector-links")
    roots = components(found.select(F.col("class").alias("a"), "b").distinct(), name="vector-components")
    groups = least_ids(known.select("class", F.col("rep").alias("least")), roots, "class")
    sums = found.groupBy("class").agg(F.sum("links").alias("links"))
    ends = known.join(sums, "class", "left").join(groups.hint("merge"), "class")
    ends = persisted(ends.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("group_id").alias("component_id")), "vector-ends")
    discard(found)
    discard(known)
    out = packed.join(ends, ["label", "vec"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
