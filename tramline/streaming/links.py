"""Streams of link events (ts, agent_id, edge_id, tt_cs, kind)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliced(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Time slices by edge; in append mode a slice comes when the watermark has passed its end."""
    x = events.where("kind = 'enter'").withWatermark("ts", late).groupBy(F.window("ts", width), "edge_id").agg(F.count("*").alias("n"), F.sum("tt_cs").alias("tt_sum"))
    return x.select("edge_id", F.unix_seconds(F.col("window.start")).alias("bin_s"), "n", "tt_sum")


def trips(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of an agent: events no further apart than ``gap``."""
    x = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "agent_id").agg(F.count("*").alias("n"))
    return x.select("agent_id", F.unix_micros(F.col("session_window.start")).alias("start_us"), F.unix_micros(F.col("session_window.end")).alias("end_us"), "n")


def occupancies(events: DataFrame) -> DataFrame:
    """Per batch and edge: vehicles on it and the mean travel time with weight 0.2, kept as state between batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on, mean = state.get if state.exists else (0, 1.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for kind, tt in zip(rows.kind, rows.tt_cs, strict=True):
            on = max(0, on + (kind == "enter") - (kind == "exit"))
            mean += 0.2 * (tt / 100 - mean)
        state.update((on, mean))
        yield pd.DataFrame({"edge_id": [key[0]], "occupancy": [on], "mean_s": [mean]})

    return events.groupBy("edge_id").applyInPandasWithState(step, "edge_id long, occupancy long, mean_s double", "occupancy long, mean_s double", "update", GroupStateTimeout.NoTimeout)
