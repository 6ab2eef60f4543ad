"""A deterministic road network and its companions, derived from the star-schema tables (no road data ships with this repository)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the node grid.
WIDTH = 40
#: Rings of the control area (outer ring, then a hole), closed, as (lng, lat).
RINGS = (
    ((116.045, 39.645), (116.245, 39.645), (116.295, 39.795), (116.195, 39.945), (116.045, 39.895), (116.045, 39.645)),
    ((116.125, 39.725), (116.165, 39.725), (116.165, 39.775), (116.125, 39.775), (116.125, 39.725)),
)
#: The second area, a box.
SECOND = ((116.205, 39.695), (116.375, 39.695), (116.375, 40.055), (116.205, 40.055), (116.205, 39.695))


@dataclass
class Network:
    """Tables of the network over one folder of Parquet files; each is a plan, nothing is read before it is used."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def nodes(self) -> DataFrame:
        key = F.col("p_partkey")
        part = self.table("part").select(key.alias("node"), (key % WIDTH).alias("gx"), F.expr(f"p_partkey div {WIDTH}").alias("gy"))
        return part.select("node", "gx", "gy", (F.lit(116.0) + F.col("gx") * F.lit(0.01)).alias("lng"), (F.lit(39.6) + F.col("gy") * F.lit(0.01)).alias("lat"))

    @cached_property
    def edges(self) -> DataFrame:
        u = self.nodes.select(F.col("node").alias("u"), "gx", "gy", F.col("lng").alias("ulng"), F.col("lat").alias("ulat"))
        ends = u.select("*", F.explode(F.array(F.struct((2 * F.col("u")).alias("edge_id"), F.when(F.col("gx") < WIDTH - 1, F.col("u") + 1).alias("v")), F.struct((2 * F.col("u") + 1).alias("edge_id"), (F.col("u") + WIDTH).alias("v")))).alias("e"))
        ends = ends.select("e.edge_id", "u", "e.v", "gx", "gy", "ulng", "ulat").where("v is not null")
        v = self.nodes.select(F.col("node").alias("v"), F.col("lng").alias("vlng"), F.col("lat").alias("vlat"))
        e = F.col("edge_id")
        kind = F.when(e % 13 == 0, "motorway").when(e % 7 == 0, "motorway_link").when(e % 3 == 0, "primary").otherwise("residential")
        return ends.join(v, "v").select("edge_id", "u", "v", "ulng", "ulat", "vlng", "vlat", (500_000 + (e * 7919 % 1000) * 1000).alias("len_mm"), kind.alias("road_class"), (e % 7 == 0).alias("is_link"), (e % 17 != 4).alias("car_access"), "gx", "gy")

    @cached_property
    def edge_keys(self) -> DataFrame:
        """Directed keys of the edges that cars may use: 2 * edge along it, 2 * edge + 1 against it unless it is one-way."""
        way = F.explode(F.array(F.lit(0), F.lit(1)))
        keys = self.edges.where("car_access").select("edge_id", "u", "v", "len_mm", way.alias("way")).where("way = 0 or edge_id % 5 <> 0")
        swap = F.col("way") == 1
        return keys.select((2 * F.col("edge_id") + F.col("way")).alias("key"), "edge_id", F.when(swap, F.col("v")).otherwise(F.col("u")).alias("from_node"), F.when(swap, F.col("u")).otherwise(F.col("v")).alias("to_node"), "len_mm")

    @cached_property
    def forbidden_turns(self) -> DataFrame:
        a = self.edge_keys.select(F.col("edge_id").alias("from_edge"), F.col("to_node").alias("via_node"))
        b = self.edge_keys.select(F.col("edge_id").alias("to_edge"), F.col("from_node").alias("via_node"))
        return a.join(b, "via_node").where("from_edge = to_edge or (from_edge * 31 + to_edge) % 17 = 0").select("from_edge", "via_node", "to_edge").distinct()

    @cached_property
    def points(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(k.alias("point_id"), (F.lit(116.0) + (k * 37 % 1000) * F.lit(0.0004)).alias("lng"), (F.lit(39.6) + (k * 91 % 1000) * F.lit(0.0005)).alias("lat"))

    @cached_property
    def raw_points(self) -> DataFrame:
        """(record_index, json): the points as source records, with defects by modulus."""
        return self.table("customer").selectExpr(
            "c_custkey as record_index",
            """case when c_custkey % 37 = 3 then '"junk"' else concat('{',
                 case when c_custkey % 23 = 0 then '' else concat('"Id":"P', cast(c_custkey - case when c_custkey % 19 = 5 then 1 else 0 end as string), '",') end,
                 case when c_custkey % 29 = 0 then '"Lng":200.5' when c_custkey % 41 = 0 then '"Lng":"abc"' else concat('"Lng":116.', lpad(cast((c_custkey * 37 % 1000) * 4 as string), 4, '0')) end,
                 ',"Lat":"', cast((396000 + (c_custkey * 91 % 1000) * 5) div 10000 as string), '.', lpad(cast((396000 + (c_custkey * 91 % 1000) * 5) % 10000 as string), 4, '0'), '"',
                 case c_custkey % 10 when 0 then ',"IsSixRingOut":"1"' when 1 then ',"IsSixRingOut":"0"' when 2 then ',"IsSixRingOut":1' when 3 then ',"IsSixRingOut":1.0' when 4 then ',"IsSixRingOut":"x"' when 5 then '' when 6 then ',"IsSixRingOut":null' else ',"IsSixRingOut":0' end,
                 ',"Address":"', case when c_custkey % 43 = 0 then ' ' else concat('Road ', cast(c_custkey % 100 as string), ' [gate] [', case when c_custkey % 2 = 0 then 'east' else 'west' end, ']') end, '"',
                 case when c_custkey % 31 = 0 then '' else ',"CameraType":"fixed"' end, '}') end as json""",
        )

    @cached_property
    def ring_segments(self) -> DataFrame:
        rows = [(r, i, *a, *b) for r, ring in enumerate(RINGS) for i, (a, b) in enumerate(zip(ring, ring[1:], strict=False))]
        return self.spark.createDataFrame(rows, "ring int, seq int, ax double, ay double, bx double, by double")

    @cached_property
    def second_segments(self) -> DataFrame:
        rows = [(i, *a, *b) for i, (a, b) in enumerate(zip(SECOND, SECOND[1:], strict=False))]
        return self.spark.createDataFrame(rows, "seq int, ax double, ay double, bx double, by double")

    @cached_property
    def tagged_edges(self) -> DataFrame:
        """Edges with way_id, identity (of the ring's relation), forward and reverse."""
        e = F.col("edge_id")
        return self.edges.withColumns({"way_id": F.expr("edge_id div 4"), "identity": e % 39 == 0, "forward": F.col("car_access"), "reverse": F.col("car_access") & (e % 5 != 0)})

    @cached_property
    def traces(self) -> DataFrame:
        """Routes that walk the grid: one for each customer, 30 steps by turns east and north."""
        start = self.table("customer").select(F.col("c_custkey").alias("route_id"))
        steps = start.select("route_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("seq"))
        gx, gy = F.col("route_id") % 8 + F.expr("(seq + 1) div 2"), F.expr("route_id % 5 + seq div 2")
        at = steps.select("route_id", "seq", gx.alias("x"), gy.alias("y")).where(f"x < {WIDTH}")
        node = F.col("y") * WIDTH + F.col("x")
        key = F.when(F.col("seq") % 2 == 0, 2 * (2 * node)).otherwise(2 * (2 * node + 1))
        repeat = F.explode(F.array(F.lit(0), F.lit(1)))
        return at.select("route_id", (2 * F.col("seq")).alias("base"), F.when(F.col("seq") % 11 == 10, -1).otherwise(key).alias("edge_key"), (F.lit(116.0) + F.col("x") * F.lit(0.01)).alias("lng"), (F.lit(39.6) + F.col("y") * F.lit(0.01)).alias("lat"), repeat.alias("half")).select("route_id", (F.col("base") + F.col("half")).alias("seq"), "edge_key", (F.col("lng") + F.col("half") * F.lit(0.004)).alias("lng"), "lat")
