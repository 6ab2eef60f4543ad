"""Clusters against plain k-means over integers."""

import hashlib

import numpy as np
import pytest

from wayfold.llm.centroids import LARGEST, Annulus, cluster, cluster_digest


def plain(rows, k, rounds, width):
    kept = [(i, [int(np.floor(float(x) * 1024)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, [max(-LARGEST, min(LARGEST, c)) for c in v]) for i, v in kept]
    order = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        centroids = [[sum(x) // len(x) for x in zip(*(v for (_, v), o in zip(kept, own, strict=True) if o == n), strict=True)] or c for n, c in enumerate(centroids)]
    return [(i, *nearest(v)[::-1]) for i, v in kept], centroids


@pytest.mark.parametrize("k", [1, 3, 8, 40])
def test_against_plain_means(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(300, 420)] + [(5, [1.0, -1.0, 0.0, 2.0]), (5, [1.0, -1.0, 0.0, 2.0]), (None, [0.0] * 4)]
    rows += [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan"), 0.0, 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [0.0] * 5), (906, [1e30, -1e30, 0.0, 1.0])]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cluster string").repartition(3)
    found, centroids = cluster(vectors, k=k, rounds=4, width=4)
    want, means = plain([(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], k, 4, 4)
    assert centroids == means
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    total = sum(r[2] for r in want)
    for r in cluster_digest(found, centroids).collect():
        assert r["inertia"] == total
        assert r["cluster_inertia"] == sum(x[2] for x in want if x[1] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, means[r["cluster"]])).encode()).hexdigest()


def test_annulus_finds_ties_and_equal_norms():
    rng = np.random.default_rng(0)
    for scale in (2, 1000, LARGEST):
        centroids = rng.integers(-scale, scale + 1, (50, 3))
        centroids[10:20] = centroids[0]
        centroids[20:30] = -centroids[1]
        x = np.concatenate([rng.integers(-scale, scale + 1, (500, 3)), centroids, np.zeros((1, 3), np.int64)])
        number, least = Annulus(centroids).nearest(x)
        d = ((x[:, None] - centroids[None]) ** 2).sum(2)
        assert (number == d.argmin(1)).all()
        assert (least == d.min(1)).all()


def test_few_and_no_vectors(spark):
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 0.0])], "vec_id long, embedding array<float>")
    found, centroids = cluster(vectors, width=2)
    assert len(centroids) == 2
    assert sorted(r["distance"] for r in found.collect()) == [0, 0]
    for none in (vectors.limit(0), vectors):
        found, centroids = cluster(none, width=3)
        assert centroids == []
        assert cluster_digest(found, centroids).count() == 0
