"""A raw road network to a clean one in one call: loops, parallel edges, contraction, components, dense ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import network
from .components import Steps, connected_components, written
from .numbering import dense_ids


@dataclass(frozen=True)
class Cleaning:
    least_component: int = 5
    simplify: bool = True
    loops: bool = True
    parallel: bool = True
    min_length: float = 20.0


def shortened(edges: DataFrame, nodes: DataFrame, min_length: float = 20.0, rounds: int = 1000) -> DataFrame:
    """``edges`` without simple nodes of two neighbours that are balanced or have an edge under ``min_length`` m (0: only balanced ones).

    An edge X -> u and the edge u -> Y (Y not X) become one that keeps the id and the other columns of the first; lengths add up, speed and
    capacity are the lesser. Edges at u without a counterpart stay. Which of two neighbouring candidates goes first matters;
    here it is the one whose id has the lesser hash, round by round, each node once.
    """
    steps = Steps(edges.sparkSession)
    now = steps.keep(edges, "short")
    done = edges.sparkSession.createDataFrame([], "node_id long")
    for _ in range(rounds):
        found = network.degree_two(now, nodes, min_length).select("node_id").join(done, "node_id", "left_anti")
        found = written(found.withColumn("order", F.xxhash64("node_id")), "candidates")
        if found.isEmpty():
            return now
        near = network.neighbours(now).join(found.select(F.col("node_id").alias("near"), F.struct("order", F.col("node_id").alias("id")).alias("other")), "near")
        first = near.groupBy(F.col("node").alias("node_id")).agg(F.min("other").alias("other"))
        chosen = found.join(first, "node_id", "left").where(F.col("other").isNull() | (F.struct("order", F.col("node_id").alias("id")) < F.col("other"))).select("node_id")
        chosen = written(chosen, "chosen")
        ins = now.join(chosen, now.to_node == chosen.node_id, "left_semi").alias("x")
        outs = now.join(chosen, now.from_node == chosen.node_id, "left_semi").select(F.col("edge_id").alias("o_id"), F.col("from_node").alias("at"), F.col("to_node").alias("y"), *(F.col(c).alias(f"o_{c}") for c in ("length_m", "speed_ms", "capacity")))
        both = written(ins.join(outs, (F.col("to_node") == F.col("at")) & (F.col("from_node") != F.col("y"))), "joined")
        merged = both.withColumns({"to_node": F.col("y"), "length_m": F.col("length_m") + F.col("o_length_m"), "speed_ms": F.least("speed_ms", "o_speed_ms"), "capacity": F.least("capacity", "o_capacity")}).select(*edges.columns)
        gone = both.select(F.explode(F.array("edge_id", "o_id")).alias("edge_id")).distinct()
        now = steps.keep(now.join(gone, "edge_id", "left_anti").select(*edges.columns).unionByName(merged), "short")
        done = done.unionByName(chosen)
    raise RuntimeError(f"candidates left after {rounds} rounds")


def reindexed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that have an edge and edges, with dense ids in the order of the old ones (edges by their ends first); old ids as old_id."""
    used = edges.select(F.explode(F.array("from_node", "to_node")).alias("node_id")).distinct()
    n = dense_ids(nodes.join(used, "node_id", "left_semi").withColumnRenamed("node_id", "old_id"), "node_id", "old_id")
    at = lambda c: n.select(F.col("old_id").alias(c), F.col("node_id").alias(f"new_{c}"))
    e = edges.join(at("from_node"), "from_node").join(at("to_node"), "to_node").drop("from_node", "to_node")
    e = e.withColumnsRenamed({"new_from_node": "from_node", "new_to_node": "to_node", "edge_id": "old_id"})
    return n, dense_ids(e, "edge_id", "from_node", "to_node", "old_id")


def cleaned(nodes: DataFrame, edges: DataFrame, options: Cleaning = Cleaning()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, report). nodes: node_id, intersection_type and more; edges: edge_id, from_node, to_node, length_m, speed_ms, capacity and more.

    report: one row of what there was, what is left, and what each step took.
    """
    o = options
    spark = edges.sparkSession
    sizes = {"nodes_before": nodes.count(), "edges_before": edges.count(), "contracted": 0}
    now, before = edges, sizes["edges_before"]

    def took(name: str, after: DataFrame) -> DataFrame:
        nonlocal before
        after = written(after, name)
        n = after.count()
        sizes[name], before = before - n, n
        return after

    now = took("loops", network.without_loops(now) if o.loops else now)
    now = took("parallel", network.deduplicated(now) if o.parallel else now)
    if o.simplify:
        now = shortened(network.contracted(now, nodes), nodes, o.min_length)
        now = network.without_loops(now) if o.loops else now
        now = took("contracted", network.deduplicated(now) if o.parallel else now)
    of = written(connected_components(now, "from_node", "to_node"), "parts")
    sizes["components"] = of.select("component").distinct().count()
    now = took("small", network.large_components(now, o.least_component, of))
    kept = of.join(now.select(F.explode(F.array("from_node", "to_node")).alias("node")).distinct(), "node", "left_semi").select("component").distinct()
    sizes["components_removed"] = sizes["components"] - kept.count()
    nodes, now = reindexed(nodes, now)
    nodes, now = written(nodes, "nodes"), written(now, "clean")
    sizes |= {"nodes_after": nodes.count(), "edges_after": now.count()}
    names = ["nodes_before", "edges_before", "loops", "parallel", "contracted", "small", "components", "components_removed", "nodes_after", "edges_after"]
    report = spark.createDataFrame([tuple(sizes[n] for n in names)], ", ".join(f"{n} long" for n in names))
    return nodes, now, report.withColumn("node_share", F.col("nodes_after") / F.greatest("nodes_before", F.lit(1)))


def build_network(osm_nodes: DataFrame, osm_ways: DataFrame, classes: DataFrame, options: Cleaning = Cleaning()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """OSM tables to (nodes, edges, report), cleaned; edges carry their way, flags, name and geometry (points)."""
    from ..sources.osm import directed_edges, junctions

    e = directed_edges(osm_nodes, osm_ways, classes)
    at = lambda p: osm_nodes.select(F.col("id").alias(f"{p}_node"), F.struct("lon", "lat").alias(f"{p}_point"))
    e = e.join(at("from"), "from_node").join(at("to"), "to_node").withColumn("points", F.array("from_point", "to_point")).drop("from_point", "to_point")
    return cleaned(junctions(osm_nodes), dense_ids(e, "edge_id", "from_node", "to_node", "way_id", "pos"), options)
