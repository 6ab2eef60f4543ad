"""Exact k-means over integer vectors by annulus search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, persisted

#: Components beyond this are set to it: squared distances of 64 components then fit 64 bits.
LARGEST = 1 << 27


@dataclass
class Annulus:
    """Centroids sorted by norm; rows of `centroids` keep their numbers."""

    centroids: np.ndarray

    def __post_init__(self) -> None:
        norms = np.sqrt((self.centroids * self.centroids).sum(1).astype(np.float64))
        self.order = np.lexsort((np.arange(len(norms)), norms))
        self.norms = norms[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid, exactly; of equal ones the smaller number.

        The centroid whose norm is nearest gives an upper bound of the distance. No centroid is nearer than the difference of
        the norms, so only those with norms within that bound of the vector's, found by binary search, are compared. The annulus
        is widened by more than floating-point errors can be, so those on its border, ties among them, are in it.
        """
        own = np.sqrt((x * x).sum(1).astype(np.float64))
        after = np.clip(np.searchsorted(self.norms, own), 0, len(self.norms) - 1)
        before = np.maximum(after - 1, 0)
        first = self.order[np.where(np.abs(self.norms[before] - own) <= np.abs(self.norms[after] - own), before, after)]
        number, least = first.copy(), ((x - self.centroids[first]) ** 2).sum(1)
        reach = np.sqrt(least.astype(np.float64)) * (1 + 1e-9) + 1e-6 + own * 1e-9
        low, high = np.searchsorted(self.norms, own - reach, "left"), np.searchsorted(self.norms, own + reach, "right")
        for place in range(int(low.min(initial=0)), int(high.max(initial=0))):
            c = self.order[place]
            rows = np.flatnonzero((low <= place) & (place < high) & (first != c))
            d = ((x[rows] - self.centroids[c]) ** 2).sum(1)
            better = (d < least[rows]) | ((d == least[rows]) & (c < number[rows]))
            number[rows[better]], least[rows[better]] = c, d[better]
        return number, least


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, width)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((id_col, cluster, distance), final centroids) of every vector with exactly `width` finite components.

    Components become floor(scale * x), at most LARGEST in size. The k vectors with the smallest sha256 of "seed:id" (of equal
    ones the smaller components) are the first centroids; fewer vectors give fewer. Each round assigns every vector to its
    nearest centroid and moves every centroid that has vectors to the componentwise floor of their mean; afterwards vectors are
    assigned once more. A round is one pass over the integer vectors, a table in the shared folder: tasks send k partial sums
    each, which are added by cluster and component, so that only k * width numbers meet and neither a large cluster nor many
    equal vectors matter. Null and short vectors, null or non-finite components are left out; a null id counts as empty text in
    the hash and keeps its row; repeated ids are vectors of their own; an empty table gives no rows and no centroids.
    """
    x = F.col(vector_col).cast("array<double>")
    finite = (F.size(x) == width) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(float(-LARGEST))), F.lit(float(LARGEST)))).cast("int")
    kept = persisted(vectors.where(F.coalesce(finite, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(x, whole).alias("x")), "vectors")
    first = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("h"), "x").orderBy("h", "x").limit(k)
    centroids = np.array([r["x"] for r in first.collect()], np.int64).reshape(-1, width)

    for _ in range(rounds if len(centroids) else 0):
        found = Annulus(centroids)

        def sums(batches: Iterator[pa.RecordBatch], found: Annulus = found) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((len(found.order), width), np.int64), np.zeros(len(found.order), np.int64)
            for batch in batches:
                own = _matrix(batch.column("x"), width)
                number, _ = found.nearest(own)
                order = np.argsort(number, kind="stable")
                met, at = np.unique(number[order], return_index=True)
                if len(met):
                    total[met] += np.add.reduceat(own[order], at, axis=0)
                count += np.bincount(number, minlength=len(count))
            met = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(count[met]), pa.array(total[met].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

        each = kept.select("x").mapInArrow(sums, "cluster int, n bigint, total array<bigint>").select("cluster", "n", F.posexplode("total").alias("i", "s"))
        for r in each.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
            centroids[r["cluster"], r["i"]] = r["s"] // r["n"]

    found = Annulus(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = found.nearest(_matrix(batch.column("x"), width))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    kind = kept.schema["id"].dataType.simpleString()
    out = persisted(kept.mapInArrow(assign, f"id {kind}, cluster int, distance bigint"), "clusters")
    discard(kept)
    return out.withColumnRenamed("id", id_col), centroids.tolist()


def cluster_digest(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """assigned with cluster_inertia, inertia (null where a sum passes 64 bits) and each centroid's digest; a row of totals for
    each centroid, of which there are as many as the caller asked for, goes to every task."""
    spark = assigned.sparkSession
    totals = assigned.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    totals = totals.join(totals.agg(F.try_sum("cluster_inertia").alias("inertia")).hint("broadcast"))
    named = spark.createDataFrame([(c, ",".join(map(str, x))) for c, x in enumerate(centroids)], "number int, said string")
    totals = totals.join(named, totals["cluster"] == named["number"]).select("cluster", "cluster_inertia", "inertia", F.sha2("said", 256).alias("centroid_sha256"))
    return assigned.join(F.broadcast(totals), "cluster").select(assigned.columns[0], "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
