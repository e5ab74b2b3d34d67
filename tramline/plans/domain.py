"""Domain tables made of the driver's tables with whole-number arithmetic, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import dense_ids


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def net_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A grid of suppliers, row by row, about square."""
    s = table(spark, d, "supplier")
    width = s.agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("w"))  # one row
    return s.crossJoin(F.broadcast(width)).select(
        F.col("s_suppkey").alias("node_id"), (F.col("s_suppkey") % F.col("w")).alias("gx"), F.floor(F.col("s_suppkey") / F.col("w")).alias("gy"), "w",
        F.col("s_nationkey").cast("long").alias("zone"), (F.col("s_suppkey") % 7).alias("itype"),
    )


def edge_columns(f: str = "from_node", t: str = "to_node") -> dict[str, str]:
    """Attributes of an edge by its ends, as expressions that Spark and the oracle read alike."""
    return {
        "length_m": f"60 + 10 * ((31 * {f} + 17 * {t}) % 40)",
        "road_class": f"(7 * {f} + 3 * {t}) % 19",
        "speed_kmh": f"20 + 10 * ((5 * {f} + 11 * {t}) % 9)",
        "capacity": f"300 + 100 * ((3 * {f} + 7 * {t}) % 18)",
    }


def net_edges(spark: SparkSession, d: str) -> DataFrame:
    """Both directions between neighbours of the grid. An equi-join by place, then dense ids by (from, to)."""
    n = net_nodes(spark, d)
    steps = F.array(*(F.struct((F.col("gx") + x).alias("gx"), (F.col("gy") + y).alias("gy")) for x, y in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    out = n.select(F.col("node_id").alias("from_node"), F.explode(steps).alias("p")).select("from_node", "p.*")
    e = out.join(n.select(F.col("node_id").alias("to_node"), "gx", "gy"), ["gx", "gy"]).select("from_node", "to_node")
    e = e.select("*", *(F.expr(x).cast("long").alias(c) for c, x in edge_columns().items()))
    return dense_ids(e, "edge_id", "from_node", "to_node").withColumn("cost_ms", F.expr("(length_m * 3600) div speed_kmh"))


def net_streets(spark: SparkSession, d: str) -> DataFrame:
    """A network with chains: of the grid's links between rows only those at two of three columns."""
    return net_edges(spark, d).where("NOT (least(from_node, to_node) % 3 = 0 AND abs(from_node - to_node) > 1)")


def raw_edges(spark: SparkSession, d: str) -> DataFrame:
    """Uncleaned edges with loops and repeats, one for each line item."""
    n = table(spark, d, "supplier").agg(F.count("*").alias("n"))
    x = table(spark, d, "lineitem").crossJoin(F.broadcast(n))
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("raw_id"), F.col("l_suppkey").alias("from_node"), (F.col("l_partkey") % F.col("n")).alias("to_node"), F.col("l_quantity").cast("long").alias("capacity"))


def link_events(spark: SparkSession, d: str) -> DataFrame:
    """Trip events: agent, edge, time in microseconds since the epoch, travel time in hundredths of a second."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "depart").when(F.col("event_type") == "view", "enter").when(F.col("event_type") == "click", "exit").when(F.col("event_type") == "purchase", "arrive").otherwise("reroute")
    return e.select("event_id", F.col("user_id").alias("agent_id"), F.get_json_object("props", "$.k").cast("long").alias("edge_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t_s"), F.rint(F.col("value") * 100).cast("long").alias("tt_cs"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"))


def daily_trips(spark: SparkSession, d: str) -> DataFrame:
    """Trip records of zone pairs: date, period, band of distance, trips, km, mode."""
    li, o, c, s = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    km = 1 + F.col("l_partkey") % 60
    return x.select(
        F.to_date("o_orderdate").alias("day"), F.col("c_nationkey").cast("long").alias("origin"), F.col("s_nationkey").cast("long").alias("dest"), (F.col("o_orderkey") % 24).alias("period"),
        F.when(km < 2, "0.5-2").when(km < 10, "2-10").when(km < 50, "10-50").otherwise(">50").alias("band"), F.col("l_quantity").cast("long").alias("trips"), (F.col("l_quantity").cast("long") * km).alias("trip_km"),
        F.array(*map(F.lit, ("1", "2", "A_PIE", "BICI", "?")))[F.col("l_linenumber") % 5].alias("code"),
    )


def trips(spark: SparkSession, d: str) -> DataFrame:
    """Agents with a route: an order is a trip, its line items are the edges it takes."""
    n = net_edges(spark, d).agg(F.count("*").alias("n"))
    x = table(spark, d, "lineitem").crossJoin(F.broadcast(n))
    return x.select(F.col("l_orderkey").alias("agent_id"), F.col("l_linenumber").cast("long").alias("pos"), F.col("l_partkey").alias("part"), (F.col("l_partkey") % F.col("n")).alias("edge_id"), ((F.col("l_orderkey") * 37) % 86400).alias("depart_s"))


_CLASS = edge_columns("a.node_id", "b.node_id")
SQL = {
    "net_nodes": "net_nodes AS (SELECT s_suppkey AS node_id, s_suppkey % w AS gx, s_suppkey // w AS gy, w, s_nationkey::BIGINT AS zone, s_suppkey % 7 AS itype FROM supplier, (SELECT ceil(sqrt(count(*)))::BIGINT AS w FROM supplier) AS g)",
    "net_edges": "net_edges AS (SELECT *, (length_m * 3600) // speed_kmh AS cost_ms FROM (SELECT row_number() OVER (ORDER BY a.node_id, b.node_id) - 1 AS edge_id, a.node_id AS from_node, b.node_id AS to_node, " + ", ".join(f"({x})::BIGINT AS {c}" for c, x in _CLASS.items()) + " FROM net_nodes AS a JOIN net_nodes AS b ON abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1) AS e)",
    "net_streets": "net_streets AS (SELECT * FROM net_edges WHERE NOT (least(from_node, to_node) % 3 = 0 AND abs(from_node - to_node) > 1))",
    "raw_edges": "raw_edges AS (SELECT l_orderkey * 10 + l_linenumber AS raw_id, l_suppkey AS from_node, l_partkey % n AS to_node, l_quantity::BIGINT AS capacity FROM lineitem, (SELECT count(*) AS n FROM supplier) AS g)",
    "link_events": "link_events AS (SELECT event_id, user_id AS agent_id, json_extract(props, '$.k')::BIGINT AS edge_id, floor(epoch(ts))::BIGINT AS t_s, round_even(value * 100, 0)::BIGINT AS tt_cs, CASE event_type WHEN 'signup' THEN 'depart' WHEN 'view' THEN 'enter' WHEN 'click' THEN 'exit' WHEN 'purchase' THEN 'arrive' ELSE 'reroute' END AS kind, ts FROM events)",
    "daily_trips": "daily_trips AS (SELECT o_orderdate::DATE AS day, c_nationkey::BIGINT AS origin, s_nationkey::BIGINT AS dest, o_orderkey % 24 AS period, CASE WHEN km < 2 THEN '0.5-2' WHEN km < 10 THEN '2-10' WHEN km < 50 THEN '10-50' ELSE '>50' END AS band, l_quantity::BIGINT AS trips, l_quantity::BIGINT * km AS trip_km, (['1','2','A_PIE','BICI','?'])[1 + l_linenumber % 5] AS code FROM (SELECT *, 1 + l_partkey % 60 AS km FROM lineitem) AS li JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)",
    "trips": "trips AS (SELECT l_orderkey AS agent_id, l_linenumber::BIGINT AS pos, l_partkey AS part, l_partkey % n AS edge_id, (l_orderkey * 37) % 86400 AS depart_s FROM lineitem, (SELECT count(*) AS n FROM net_edges) AS g)",
}
_NEEDS = {"net_edges": ["net_nodes"], "net_streets": ["net_nodes", "net_edges"], "trips": ["net_nodes", "net_edges"]}


def with_(*names: str, recursive: bool = False) -> str:
    """The WITH clause that gives these tables; more may follow behind a comma."""
    need: list[str] = []
    for n in names:
        need += [x for x in (*_NEEDS.get(n, ()), n) if x not in need]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(SQL[n] for n in need)
