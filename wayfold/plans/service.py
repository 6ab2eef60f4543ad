"""What a user asks of a published snapshot: points, status, area, readiness, refreshes; and building and checking a network."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.config import Settings
from wayfold.functions import geo
from wayfold.operators import spatial
from wayfold.plans.snapshot import SnapshotStore, version_of


class Service:
    """Queries over the snapshot in service. Each resolves the version once, so that its tables belong together."""

    def __init__(self, store: SnapshotStore, settings: Settings | None = None):
        self.store, self.settings = store, settings or Settings()
        self._busy, self._pool = threading.Lock(), ThreadPoolExecutor(1)

    def points_in_bbox(self, bounds: tuple[float, float, float, float], crs: str = "WGS84") -> DataFrame:
        """Points of the snapshot in bounds, in the asked coordinate system; too many are an error."""
        points = self.store.read("points", self.store.current()).withColumnRenamed("id", "point_id")
        return spatial.points_in_bounds(points, bounds, crs, self.settings.most_points)

    def status(self) -> dict:
        """Version, inputs and counts of the snapshot in service; {} without one."""
        version = self.store.current()
        return {"version": version, **self.store.manifest(version)} if version else {}

    def control_area(self, rings: DataFrame, crs: str = "GCJ02") -> DataFrame:
        """rings (role, ring, seq, lng, lat) in the asked coordinate system."""
        if crs == "WGS84":
            return rings
        at = geo.to_gcj02(F.col("lng"), F.col("lat"))
        return rings.withColumn("at", at).withColumns({"lng": F.col("at.lng"), "lat": F.col("at.lat")}).drop("at")

    def readiness(self, graph: tuple[str, str, str] | None = None, topology: tuple[str, ...] = (), **expected: str) -> dict[str, bool]:
        """Whether a snapshot is in service, and whether its inputs have the expected versions; with `graph` (root, source and schema
        version) whether that network is built and whole, with `topology` whether the snapshot has these tables with rows."""
        version = self.store.current()
        found = {"snapshot": version is not None, "versions": self.store.ready(**expected)}
        if graph:
            found["graph"] = not check_graph(self.store.spark, *graph)
        if topology:
            tables = self.store.manifest(version).get("tables", []) if version else []
            found["topology"] = all(t in tables and not self.store.read(t, version).isEmpty() for t in topology)
        return found

    def request_refresh(self, work: Callable[[], object]) -> Future | None:
        """Runs work in the background, one at a time: None if another refresh is running."""
        if not self._busy.acquire(blocking=False):
            return None

        def run() -> object:
            try:
                return work()
            finally:
                self._busy.release()

        return self._pool.submit(run)


def build_graph(edges: DataFrame, root: str, source_version: str, schema_version: str) -> str:
    """Writes a network's edges under their version, unless they are there, with a manifest of what they were built from."""
    spark = edges.sparkSession
    store = SnapshotStore(spark, root)
    version = version_of({"source": source_version, "schema": schema_version})
    if not store.manifest(version):
        edges.write.mode("overwrite").parquet(f"{root}/{version}/edges")
        counts = edges.agg(F.count("*").alias("edges"), F.count_if("car_access").alias("drivable")).first().asDict()
        store._put(f"{version}/manifest.json", json.dumps({"source": source_version, "schema": schema_version, **counts}))
    return version


def check_graph(spark: SparkSession, root: str, source_version: str, schema_version: str) -> list[str]:
    """What is wrong with the network built from these inputs: [] if it is there and whole."""
    store, version = SnapshotStore(spark, root), version_of({"source": source_version, "schema": schema_version})
    manifest = store.manifest(version)
    if not manifest:
        return ["not built"]
    edges = spark.read.parquet(f"{root}/{version}/edges")
    found = edges.agg(F.count("*").alias("edges"), F.count_if("car_access").alias("drivable")).first().asDict()
    return [f"{k}: {found[k]} instead of {manifest[k]}" for k in found if found[k] != manifest[k]] + ([] if found["drivable"] else ["no drivable edge"])


def area_problems(area: DataFrame, parts: DataFrame, border: DataFrame, far_degrees: float = 0.005) -> DataFrame:
    """(problem): what is wrong with an area of ring segments (ring, seq, ax, ay, bx, by): rings that don't close or have under
    three sides, corners of its parts (same columns) outside it, and border points (lng, lat) farther from it than allowed."""
    ends = area.groupBy("ring").agg(F.min_by(F.struct("ax", "ay"), "seq").alias("first"), F.max_by(F.struct(F.col("bx").alias("ax"), F.col("by").alias("ay")), "seq").alias("last"), F.count("*").alias("n"))
    open_rings = ends.where("first <> last or n < 3").select(F.concat(F.lit("ring is not closed: "), F.col("ring").cast("string")).alias("problem"))
    corners = parts.select(F.col("ax").alias("lng"), F.col("ay").alias("lat")).distinct().withColumn("k", F.xxhash64("lng", "lat"))
    outside = spatial.locate(corners, area, ["k"]).where("location = 'OUTSIDE' and near_deg > 1e-9").select(F.format_string("part leaves the area at %.6f %.6f", "lng", "lat").alias("problem"))
    line = border.withColumn("k", F.xxhash64("lng", "lat")).dropDuplicates(["k"])
    far = spatial.locate(line, area, ["k"]).where(F.col("near_deg") > far_degrees).select(F.format_string("border is far from the area at %.6f %.6f", "lng", "lat").alias("problem"))
    return open_rings.unionByName(outside).unionByName(far)
