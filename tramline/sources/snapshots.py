"""Snapshots of link states over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def nearest(snapshots: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the snapshot (time_s) nearest to the one time of ``wanted`` (a row, a column); the earlier of two."""
    times = snapshots.select("time_s").distinct().crossJoin(F.broadcast(wanted.toDF("_at")))
    best = times.agg(F.min(F.struct(F.abs(F.col("time_s") - F.col("_at")).alias("d"), "time_s")).alias("x")).select("x.time_s")
    return snapshots.join(F.broadcast(best), "time_s", "left_semi")


def segments(lines: DataFrame) -> DataFrame:
    """Each polyline (points array<struct<lon, lat>>) as pairs of neighbours."""
    x = lines.where(F.size("points") > 1).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("points") - 1)))
    a, b = F.element_at("points", F.col("i")), F.element_at("points", F.col("i") + 1)
    return x.select(*(c for c in lines.columns if c != "points"), a["lon"].alias("lon1"), a["lat"].alias("lat1"), b["lon"].alias("lon2"), b["lat"].alias("lat2"))


def box(pieces: DataFrame, margin: float = 0.008) -> DataFrame:
    """One row: the box of segments with a margin."""
    low, high = (lambda c: F.least(F.min(f"{c}1"), F.min(f"{c}2")) - margin), (lambda c: F.greatest(F.max(f"{c}1"), F.max(f"{c}2")) + margin)
    return pieces.agg(low("lon").alias("west"), low("lat").alias("south"), high("lon").alias("east"), high("lat").alias("north"))


def congestion_map(spark: SparkSession, path: str, time_s: float) -> DataFrame:
    """(time_s, edge_id, congestion, travel_time_s, points) of the snapshot nearest to ``time_s`` in what a scenario wrote as GeoJSON: congestion by edge, with its line."""
    feature = "struct<properties:struct<time_s:double,edge_id:long,congestion:double,travel_time_s:double>,geometry:struct<coordinates:array<array<double>>>>"
    x = spark.read.text(path).select(F.from_json("value", feature).alias("f")).where("f.properties.time_s IS NOT NULL")
    line = F.transform("f.geometry.coordinates", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return nearest(x.select("f.properties.*", line.alias("points")), spark.createDataFrame([(float(time_s),)], "at double"))
