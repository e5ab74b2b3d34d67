"""Measures over link events, link states and trips."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import along
from ..functions.traffic import bpr_time_s, congestion_index, density_veh_km, flow_veh_h, geh, los


def time_slices(events: DataFrame, width_s: int, until_s: Column | None = None) -> DataFrame:
    """(edge_id, bin_s, n, tt_sum) of enter events by the time of entry; with ``until_s`` only bins that are over by then."""
    x = events.withColumn("bin_s", F.floor(F.col("t_s") / width_s) * width_s).groupBy("edge_id", "bin_s").agg(F.count("*").alias("n"), F.sum("tt_cs").alias("tt_sum"))
    return x.where(F.col("bin_s") + width_s <= until_s) if until_s is not None else x


def trip_clock(steps: DataFrame) -> DataFrame:
    """Steps of routes (agent_id, pos, tt, depart) with enter and exit times: the sum of what lies before."""
    before = Window.partitionBy("agent_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    enter = F.col("depart") + F.coalesce(F.sum("tt").over(before), F.lit(0))
    return steps.withColumn("enter", enter).withColumn("exit", F.col("enter") + F.col("tt"))


def processing_window(steps: DataFrame, start: int, width: int) -> DataFrame:
    """``steps`` (agent_id, k, enter) with the window in which an engine that moves an agent one edge a window handles them:
    k + the largest f_j - j so far, f_j the window of the j-th enter time."""
    so_far = Window.partitionBy("agent_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("window", F.col("k") + F.max(F.floor((F.col("enter") - start) / width) - F.col("k")).over(so_far))


def occupancy(passages: DataFrame) -> DataFrame:
    """(edge_id, t, occupancy): vehicles on the edge after each instant at which one enters or leaves. Changes at an instant are
    added up first, so a busy edge's rows are its instants."""
    change = passages.select("edge_id", F.explode(F.array(F.struct(F.col("enter").alias("t"), F.lit(1).alias("d")), F.struct(F.col("exit").alias("t"), F.lit(-1).alias("d")))).alias("x")).select("edge_id", "x.*")
    change = change.groupBy("edge_id", "t").agg(F.sum("d").alias("d"))
    return change.select("edge_id", "t", F.sum("d").over(Window.partitionBy("edge_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)).alias("occupancy"))


def snapshot(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Occupied edges (edge_id, occupancy) with travel time, congestion, speed, flow and density."""
    x = state.where("occupancy > 0").join(edges, "edge_id")
    x = x.withColumn("free_flow_s", F.col("length_m") / F.col("speed_ms"))
    x = x.withColumn("travel_time_s", bpr_time_s(F.col("occupancy"), F.col("length_m"), F.col("capacity"), F.col("free_flow_s")))
    return x.withColumns({
        "congestion": congestion_index(F.col("travel_time_s"), F.col("free_flow_s")), "speed_now_ms": F.col("length_m") / F.col("travel_time_s"),
        "flow_veh_h": flow_veh_h(F.col("occupancy"), F.col("travel_time_s"), F.col("capacity")), "density_veh_km": density_veh_km(F.col("occupancy"), F.col("length_m")),
    })


def performance(snap: DataFrame, n_edges: int) -> DataFrame:
    """One row: VKT, VHT, mean speed, congestion index, share of congested edges."""
    busy = F.col("occupancy") * 3600 / F.col("travel_time_s") / F.col("capacity") > 0.9
    x = snap.agg(
        (F.sum(F.col("occupancy") * F.col("length_m")) / 1000).alias("vkt"), (F.sum(F.col("occupancy") * F.col("travel_time_s")) / 3600).alias("vht"),
        (F.sum(F.col("occupancy") * F.col("free_flow_s")) / 3600).alias("vht_free"), F.sum(busy.cast("int")).alias("n_busy"),
    )
    return x.select("vkt", "vht", (F.col("vkt") / F.col("vht")).alias("speed_kmh"), (F.col("vht") / F.col("vht_free") - 1).alias("congestion_index"), (F.col("n_busy") / n_edges).alias("fraction_congested"))


def count_comparison(simulated: DataFrame, observed: DataFrame) -> DataFrame:
    """(edge_id, simulated, observed, geh, los) of edges in both."""
    return simulated.join(observed, "edge_id").select("edge_id", "simulated", "observed", geh(F.col("simulated"), F.col("observed")).alias("geh"), los(F.when(F.col("observed") > 0, F.col("simulated") / F.col("observed")).otherwise(0.0)).alias("los"))


def pass_rate(compared: DataFrame, below: float = 5.0) -> DataFrame:
    return compared.agg(F.coalesce(F.avg((F.col("geh") < below).cast("double")), F.lit(0.0)).alias("pass_rate"))


def completion_bucket(done: Column, total: Column) -> Column:
    """Share of a route that is behind: under 25, 50, 75, 99 % or more."""
    r = done / total
    return F.when(r < 0.25, "<25%").when(r < 0.5, "25-50%").when(r < 0.75, "50-75%").when(r < 0.99, "75-99%").otherwise(">=99%")


def duration_bucket(seconds: Column) -> Column:
    return F.when(seconds < 1800, "<30m").when(seconds < 3600, "30-60m").when(seconds < 7200, "1-2h").when(seconds < 14400, "2-4h").otherwise(">=4h")


def peak_hour(departures: DataFrame) -> DataFrame:
    """One row: the hour with most departures, the earliest of equals, and how many."""
    h = departures.groupBy(F.least(F.lit(23), F.floor(F.col("depart_s") / 3600)).cast("long").alias("hour")).agg(F.count("*").alias("n"))
    return h.agg(F.max_by("hour", F.struct("n", -F.col("hour"))).alias("hour"), F.max("n").alias("n"))


def reroute_candidates(positions: DataFrame, steps: DataFrame, congested: DataFrame, ahead: int = 200) -> DataFrame:
    """(agent_id): agents with a congested edge among the next ``ahead`` of their route."""
    x = steps.join(positions.select("agent_id", F.col("pos").alias("_now")), "agent_id").where((F.col("pos") > F.col("_now")) & (F.col("pos") <= F.col("_now") + ahead))
    return x.join(congested, "edge_id", "left_semi").select("agent_id").distinct()


def shares(counts: DataFrame, n: str = "n") -> DataFrame:
    """``counts`` with each row's share of all (a row a class)."""
    return counts.crossJoin(F.broadcast(counts.agg(F.sum(n).alias("_all")))).withColumn("share", F.col(n) / F.col("_all")).drop("_all")


def capped_histogram(values: DataFrame, column: str, most: int = 31) -> DataFrame:
    """(bin, n): how often each whole number occurs; greater ones count as ``most``."""
    return values.groupBy(F.least(F.col(column), F.lit(most)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def peak_volume(departures: DataFrame, edges: DataFrame, car_class: int = 13) -> DataFrame:
    """One row: the hour with most departures, how many, and their ratio to the capacity of all edges open to cars."""
    capacity = edges.where(F.col("road_class") <= car_class).agg(F.sum("capacity").alias("capacity"))
    return peak_hour(departures).crossJoin(F.broadcast(capacity)).withColumn("vc", F.col("n") / F.col("capacity"))


def class_capacity(edges: DataFrame, car_class: int = 13) -> DataFrame:
    """(road_class, n_edges, capacity, share): share of the capacity of the classes open to cars, null for others."""
    own = edges.groupBy("road_class").agg(F.count("*").alias("n_edges"), F.sum("capacity").alias("capacity"))
    car = own.where(F.col("road_class") <= car_class).agg(F.sum("capacity").alias("_car"))
    return own.crossJoin(F.broadcast(car)).withColumn("share", F.when(F.col("road_class") <= car_class, F.col("capacity") / F.col("_car"))).drop("_car")


def teleports(log: DataFrame, agents: DataFrame, edges: DataFrame) -> DataFrame:
    """(road_class, reroutes, n) of teleports, from an engine's events and agents."""
    x = log.where("kind = 'teleport'").join(agents.select("run", "agent_id", "reroutes"), ["run", "agent_id"]).join(edges.select("edge_id", "road_class"), "edge_id", "left")
    return x.groupBy("road_class", F.least("reroutes", F.lit(31)).alias("reroutes")).agg(F.count("*").alias("n"))


def active_agents(agents: DataFrame) -> DataFrame:
    """One row: agents on a link or waiting."""
    return agents.agg(F.count_if(F.col("state").isin("on_link", "waiting")).alias("n_active"))


def positions(agents: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(agent_id, edge_id, lon, lat): agents on an edge (agent_id, edge_id) at the node that it leads to."""
    x = agents.join(edges.select("edge_id", F.col("to_node").alias("node_id")), "edge_id").join(nodes.select("node_id", "lon", "lat"), "node_id")
    return x.select("agent_id", "edge_id", "lon", "lat")


def ticks(occupancies: DataFrame, every: int, until: int) -> DataFrame:
    """(edge_id, tick, occupancy) at 0, every, 2 every, ... up to ``until`` of (edge_id, t, occupancy) after each change; only links in use.

    A change counts from the first tick that is not before it, and holds until the tick of the next.
    """
    x = occupancies.withColumn("tick", F.ceil(F.col("t") / every)).groupBy("edge_id", "tick").agg(F.max_by("occupancy", "t").alias("occupancy"))
    after = F.lead("tick", 1, until // every + 1).over(Window.partitionBy("edge_id").orderBy("tick"))
    x = x.withColumn("next", F.least(after, F.lit(until // every + 1))).where("occupancy > 0 AND next > tick")
    return x.select("edge_id", F.explode(F.sequence("tick", F.col("next") - 1)).alias("tick"), "occupancy").withColumn("tick", F.col("tick") * every)


def trajectories(passages: DataFrame, lines: DataFrame, every: int) -> DataFrame:
    """(agent_id, t, edge_id, lon, lat): where each vehicle is at the ticks 0, every, 2 every, ... at which it is on an edge.

    A tick belongs to the passage (agent_id, edge_id, enter, exit) that it falls in, from its enter to before its exit; the place lies along the
    edge's line (edge_id, points) by the share of the passage's time. Each passage makes its own ticks, so no tick is joined with what does not hold it.
    """
    first = F.ceil(F.col("enter") / every) * every
    x = passages.where(first < F.col("exit")).withColumn("t", F.explode(F.sequence(first.cast("long"), (F.col("exit") - 1).cast("long"), F.lit(every).cast("long"))))
    place = along(F.col("points"), (F.col("t") - F.col("enter")) / (F.col("exit") - F.col("enter")))
    return x.join(lines.select("edge_id", "points"), "edge_id").select("agent_id", "t", "edge_id", place.alias("p")).select("agent_id", "t", "edge_id", "p.lon", "p.lat")


def activities(passages: DataFrame, edges: DataFrame, goal: str = "activity") -> DataFrame:
    """(agent_id, kind, t, node_id): where and when each agent departs, and where and when it comes to its ``goal``."""
    x = passages.join(edges.select("edge_id", "from_node", "to_node"), "edge_id").groupBy("agent_id").agg(
        F.min(F.struct(F.col("enter").alias("t"), F.col("exit").alias("_e"), F.col("from_node").alias("node_id"))).alias("a"), F.max(F.struct(F.col("exit").alias("t"), F.col("enter").alias("_e"), F.col("to_node").alias("node_id"))).alias("b")
    )
    rows = F.array(F.struct(F.lit("depart").alias("kind"), "a.t", "a.node_id"), F.struct(F.lit(goal).alias("kind"), "b.t", "b.node_id"))
    return x.select("agent_id", F.explode(rows).alias("r")).select("agent_id", "r.*")


def gated(links: DataFrame, every: float) -> DataFrame:
    """Of an engine's link windows (window_s) the first at or behind each multiple of ``every``: what a writer of snapshots gets."""
    times = links.select("window_s").distinct()
    first = times.groupBy(F.floor(F.col("window_s") / every)).agg(F.min("window_s").alias("window_s")).select("window_s")
    return links.join(F.broadcast(first), "window_s", "left_semi")  # a row a snapshot


def ema(events: DataFrame, weight: float = 0.2, start: float = 1.0) -> DataFrame:
    """(edge_id, n, mean): the running mean of (edge_id, t, id, value) in the order of (t, id). Rows stream through their task; a busy edge is never held."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, mean = None, 0, start
        names = ["edge_id", "n", "mean"]
        for batch in batches:
            out = []
            for e, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n and e != at:
                    out.append((at, n, mean))
                    n, mean = 0, start
                at, n, mean = e, n + 1, mean + weight * (v - mean)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (at, n, mean)], names)

    rows = events.repartition("edge_id").sortWithinPartitions("edge_id", "t", "id").select("edge_id", "value")
    return rows.mapInArrow(fold, "edge_id long, n long, mean double")
