"""OpenStreetMap tables: nodes (id, lon, lat, tags), ways (id, nodes, tags), relations (id, members, tags)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import haversine_m
from ..functions.network import CLASS_DEFAULTS, edge_flags, has_access, lane_count, maxspeed_kmh, node_type, oneway, restriction_kind
from ..operators.cleaning import Cleaning, build_network


def way_segments(steps: DataFrame) -> DataFrame:
    """(way, pos, from_node, to_node): neighbours along each way; steps from a node to itself go. steps: (way, pos, node)."""
    x = steps.withColumn("to_node", F.lead("node").over(Window.partitionBy("way").orderBy("pos", "node")))
    return x.where("to_node IS NOT NULL AND to_node <> node").select("way", "pos", F.col("node").alias("from_node"), "to_node")


def class_table(spark: SparkSession, overrides: dict[str, tuple] | None = None) -> DataFrame:
    """(highway, road_class, base_kmh, base_lanes, per_lane); overrides replace built-in rows."""
    rows = CLASS_DEFAULTS | (overrides or {})
    names = list(CLASS_DEFAULTS)
    return spark.createDataFrame([(h, names.index(h) if h in names else 255, float(v), int(n), float(c)) for h, (v, n, c) in rows.items()], "highway string, road_class int, base_kmh double, base_lanes int, per_lane double")


def directed_edges(nodes: DataFrame, ways: DataFrame, classes: DataFrame) -> DataFrame:
    """Directed edges of car-accessible ways: (way_id, pos, from_node, to_node, length_m, speed_ms, capacity, road_class, flags, name).

    Segments under 0.1 m or with a node that is not known go; ways against their direction are turned; others give both.
    """
    tag = lambda k: F.col("tags")[k]
    w = ways.where(has_access(F.col("tags"))).withColumn("highway", tag("highway")).join(F.broadcast(classes), "highway")
    lanes = lane_count(tag("lanes"), F.col("base_lanes"))
    round_ = tag("junction") == "roundabout"
    way = oneway(tag("oneway"))
    w = w.select(
        F.col("id").alias("way"), "nodes", "road_class", (maxspeed_kmh(tag("maxspeed"), F.col("base_kmh")) / 3.6).alias("speed_ms"), (lanes * F.col("per_lane")).alias("capacity"), way.alias("direction"),
        edge_flags(way != 0, tag("bridge") == "yes", tag("tunnel") == "yes", round_, F.lit(False)).alias("flags"), tag("name").alias("name"),
    )
    seg = way_segments(w.select("way", F.posexplode("nodes").alias("pos", "node")))
    at = lambda p: nodes.select(F.col("id").alias(f"{p}_node"), F.col("lon").alias(f"{p}_lon"), F.col("lat").alias(f"{p}_lat"))
    seg = seg.join(at("from"), "from_node").join(at("to"), "to_node")
    seg = seg.withColumn("length_m", haversine_m(F.col("from_lon"), F.col("from_lat"), F.col("to_lon"), F.col("to_lat"))).where("length_m >= 0.1")
    x = seg.join(w.drop("nodes"), "way")
    ahead = F.struct(F.col("from_node").alias("a"), F.col("to_node").alias("b"), F.col("flags").alias("f"))
    back = F.struct(F.col("to_node").alias("a"), F.col("from_node").alias("b"), F.col("flags").bitwiseOR(64).alias("f"))
    x = x.withColumn("d", F.explode(F.when(F.col("direction") == 1, F.array(ahead)).when(F.col("direction") == -1, F.array(back)).otherwise(F.array(ahead, back))))
    return x.select(F.col("way").alias("way_id"), "pos", F.col("d.a").alias("from_node"), F.col("d.b").alias("to_node"), "length_m", "speed_ms", "capacity", "road_class", F.col("d.f").alias("flags"), "name")


def junctions(nodes: DataFrame) -> DataFrame:
    """(node_id, lon, lat, intersection_type)."""
    return nodes.select(F.col("id").alias("node_id"), "lon", "lat", node_type(F.col("tags")).alias("intersection_type"))


def turn_restrictions(relations: DataFrame) -> DataFrame:
    """(from_way, to_way, via_node, kind) of relations that name all three."""
    one = lambda role, kind: F.try_element_at(F.filter("members", lambda m: (m["role"] == role) & (m["type"] == kind)), F.lit(1))["ref"]
    x = relations.select(one("from", "way").alias("from_way"), one("to", "way").alias("to_way"), one("via", "node").alias("via_node"), restriction_kind(F.col("tags")["restriction"]).alias("kind"))
    return x.where("from_way IS NOT NULL AND to_way IS NOT NULL AND via_node IS NOT NULL AND kind IS NOT NULL")


def from_pbf(spark: SparkSession, path: str, cleaning: Cleaning | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean nodes and edges of a PBF file or a folder of them, and what cleaning did: from a download to a network in one call.

    An element that several files have counts once.
    """
    from .pbf import tables

    nodes, ways, _ = tables(spark, path)
    return build_network(nodes.dropDuplicates(["id"]), ways.dropDuplicates(["id"]), class_table(spark), cleaning or Cleaning())
