"""Scenarios: settings as JSON, and a façade that runs them."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, dataclass, field, fields
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analytics, demand, engine, hierarchy, routing
from .operators.numbering import dense_ids
from .sources import tables


def seconds(value: str | float) -> float:
    """Seconds since midnight of a number or of "YYYY-MM-DD HH:MM:SS"."""
    try:
        return float(value)
    except ValueError:
        t = datetime.strptime(str(value), "%Y-%m-%d %H:%M:%S")
        return t.hour * 3600.0 + t.minute * 60 + t.second


@dataclass
class Simulation:
    start_time: float = 0.0
    end_time: float = 86400.0
    sync_window_s: float = 30.0
    reroute_interval_s: float = 0.0
    reroute_threshold: float = 0.20
    max_reroutes: int = 10
    stuck_ratio: float = 0.0
    stuck_cap_s: float = 0.0
    seed: int = 42


@dataclass
class Demand:
    source: str = ""
    demand_scale: float = 1.0
    modes: list[str] = field(default_factory=list)


@dataclass
class Traffic:
    model: str = "queue"
    burst_s: float = 0.0


@dataclass
class Routing:
    algorithm: str = "dijkstra"
    sigma: float = 0.0
    index: str = ""


@dataclass
class Output:
    directory: str = "out"
    format: str = "parquet"
    snapshot_interval_s: float = 300.0


@dataclass
class Scenario:
    name: str = "scenario"
    network: str = ""
    simulation: Simulation = field(default_factory=Simulation)
    demand: Demand = field(default_factory=Demand)
    traffic: Traffic = field(default_factory=Traffic)
    routing: Routing = field(default_factory=Routing)
    output: Output = field(default_factory=Output)

    @classmethod
    def from_dict(cls, raw: dict) -> Scenario:
        """Every field has a default; unknown sections and fields are errors."""
        out = cls()
        for key, value in raw.items():
            if not hasattr(out, key):
                raise ValueError(f"unknown setting {key!r}")
            part = getattr(out, key)
            if not isinstance(value, dict):
                setattr(out, key, value)
                continue
            known = {f.name for f in fields(part)}
            for k, v in value.items():
                if k not in known:
                    raise ValueError(f"unknown setting {key}.{k}")
                setattr(part, k, seconds(v) if k in ("start_time", "end_time") else v)
        if problem := out.problem():
            raise ValueError(problem)
        return out

    @classmethod
    def load(cls, path: str) -> Scenario:
        with open(path) as f:
            return cls.from_dict(json.load(f))

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=2)

    def problem(self) -> str:
        """What is wrong with the settings; empty if nothing is."""
        s = self.simulation
        if s.end_time <= s.start_time:
            return "end_time must be after start_time"
        if s.sync_window_s <= 0:
            return "sync_window_s must be positive"
        if not 0 <= self.demand.demand_scale <= 1:
            return "demand_scale must be between 0 and 1"
        if self.traffic.model not in engine.MODELS:
            return f"unknown traffic model {self.traffic.model!r}"
        if self.routing.algorithm not in ("dijkstra", "stochastic", "hierarchy"):
            return f"unknown routing algorithm {self.routing.algorithm!r}"
        if self.output.format not in tables.FORMATS:
            return f"unknown output format {self.output.format!r}"
        if self.output.snapshot_interval_s <= 0:
            return "snapshot_interval_s must be positive"
        return ""

    def folder(self, date: str = "") -> str:
        """Output folder with the date, if there is one, and the time span in its name."""
        label = lambda t: f"{int(t) // 3600:02d}-{int(t) // 60 % 60:02d}"
        return f"{self.output.directory}/{date + '_' if date else ''}{label(self.simulation.start_time)}_{label(self.simulation.end_time)}"

    def options(self) -> engine.Options:
        s = self.simulation
        return engine.Options(s.sync_window_s, s.end_time, self.traffic.model, self.traffic.burst_s, s.reroute_interval_s, s.reroute_threshold, s.max_reroutes, s.reroute_interval_s > 0, s.stuck_ratio, s.stuck_cap_s)

    def run(self, edges: DataFrame, od: DataFrame, table: str = "events") -> DataFrame:
        """Routes the demand over free-flow times and simulates it. od: (od_id, origin_node, dest_node, count, mode, depart_start_s, depart_end_s).

        With the algorithm "stochastic" and a sigma, agents get routes of their own. With "hierarchy" they are found over a contraction
        hierarchy: that in the folder ``index``, which is made and saved there if there is none; one of another network is an error.
        """
        kept = demand.thinned(demand.od_window(od, self.simulation.start_time, self.simulation.end_time, self.demand.modes), self.demand.demand_scale, self.simulation.seed)
        trips = demand.agents(kept, self.simulation.seed, self.simulation.start_time)
        trips = dense_ids(trips.withColumns({"origin": F.col("origin_node"), "dest": F.col("dest_node")}), "agent_id", "od_id", "i")
        timed = edges.withColumn("cost", F.col("length_m") / F.col("speed_ms"))
        trips = trips.select("agent_id", "mode", "depart_s", "origin", "dest")
        if self.routing.algorithm == "hierarchy":
            found = hierarchy.routes(self._index(timed), trips)
        else:
            found = routing.routes(trips, timed, "cost", self.routing.sigma if self.routing.algorithm == "stochastic" else 0.0)
        return engine.sweep(found.withColumn("run", F.lit(0).cast("long")).drop("cost"), edges, self.options(), table)

    def _index(self, timed: DataFrame) -> hierarchy.Hierarchy:
        path = self.routing.index
        if not path:
            return hierarchy.contracted(timed)
        try:
            return hierarchy.loaded(timed, path)
        except AnalysisException:  # nothing there yet
            hierarchy.saved(hierarchy.contracted(timed), path)
            return hierarchy.loaded(timed, path)

    def snapshots(self, nodes: DataFrame, edges: DataFrame, od: DataFrame) -> DataFrame:
        """Occupied links at each ``snapshot_interval_s`` of a run, with travel time, congestion, speed, flow, density and geometry."""
        links = analytics.gated(self.run(edges, od, "links"), self.output.snapshot_interval_s)
        at = lambda c: nodes.select(F.col("node_id").alias(f"{c}_node"), F.struct("lon", "lat").alias(c))
        e = edges if "points" in edges.columns else edges.join(at("from"), "from_node").join(at("to"), "to_node").withColumn("points", F.array("from", "to"))
        x = analytics.snapshot(links.select(F.col("window_s").alias("time_s"), "edge_id", "occupancy"), e)
        return x.select("time_s", "edge_id", "road_class", F.col("occupancy").alias("count"), "congestion", "travel_time_s", F.col("free_flow_s").alias("free_flow_time_s"), "length_m", F.col("speed_now_ms").alias("speed_ms"), (F.col("speed_now_ms") * 3.6).alias("speed_kmh"), F.col("capacity").alias("capacity_veh_h"), "flow_veh_h", "density_veh_km", "points")

    def write(self, nodes: DataFrame, edges: DataFrame, od: DataFrame, date: str = "") -> str:
        """Runs and writes: GeoJSON and link statistics as snapshots, other formats the events. Gives the folder."""
        path = self.folder(date)
        if self.output.format == "geojson":
            snaps = self.snapshots(nodes, edges, od)
            tables.save_geojson(snaps, path, *(c for c in snaps.columns if c != "points"))
        else:
            tables.writer(self.output.format)(self.run(edges, od), path)
        return path


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tramline", description="Runs a scenario over a saved network and an OD file.")
    p.add_argument("--config", required=True)
    p.add_argument("--network", help="folder of a saved network; else the scenario's")
    p.add_argument("--osm", help="an OpenStreetMap PBF file: its network is cleaned and saved in the network folder first")
    given = p.parse_args(args)
    scenario = Scenario.load(given.config)
    spark = SparkSession.builder.appName(f"tramline {scenario.name}").getOrCreate()
    if given.osm:
        from .sources import osm

        nodes, edges, _ = osm.from_pbf(spark, given.osm)
        tables.save_network(nodes, edges, given.network or scenario.network)
    nodes, edges = tables.network(spark, given.network or scenario.network)
    od = tables.od_csv(spark, scenario.demand.source)
    od = od.groupBy(*(c for c in od.columns if c != "count")).agg(F.sum("count").alias("count"))
    scenario.write(nodes, edges, dense_ids(od, "od_id", "origin_node", "dest_node", "mode", "depart_start_s", "depart_end_s"))


if __name__ == "__main__":
    main()
