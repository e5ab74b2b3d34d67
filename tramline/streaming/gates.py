"""Links as keyed state with timers: vehicles that want to leave are let out at the rate of their link's capacity.

A link gains a permit every ``gap_us`` microseconds and holds ``burst`` of them at most. Who wants to leave takes one, or waits
at the gate for the next. Rows may come in any order within the watermark: a link keeps what has come until the watermark has passed
it, and only then takes it in the order of (time, event). A vehicle's row is given out when the watermark has passed the time at
which it leaves. Both are event-time timers of the link; one is set at a time, for what is due next. Rows behind the watermark
are dropped by Spark and counted (``late_rows``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State with timers needs this store; set it in the session that starts the query.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
RELEASES = "edge_id long, event_id long, agent_id long, at_us long, out_us long, occupancy long"


class Gate(StatefulProcessor):
    """State of a link: ready_us (when the permit after the next would be there if none were saved up), occupancy, the timer that is set; waiting rows; vehicles at the gate."""

    def __init__(self, burst: int):
        self.burst = burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.link = handle.getValueState("link", "ready_us long, occupancy long, timer_ms long")
        self.early = handle.getListState("early", "at_us long, event_id long, agent_id long, gap_us long, enters boolean")
        self.queue = handle.getListState("queue", "out_us long, at_us long, event_id long, agent_id long, occupancy long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            new = [(int(t), int(e), int(a), int(g), bool(k)) for t, e, a, g, k in frame[["at_us", "event_id", "agent_id", "gap_us", "enters"]].itertuples(index=False)]
            if new:
                self.early.appendList(new)
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Takes in and gives out all that the watermark has reached; timers at the watermark itself have fired."""
        ready, on, timer = self.link.get() if self.link.exists() else (None, 0, None)
        early, queue = sorted(tuple(r) for r in self.early.get()), [tuple(r) for r in self.queue.get()]
        due = [r for r in early if r[0] // 1000 <= watermark_ms]
        for at, event, agent, gap, enters in due:
            if enters:
                on += 1
                continue
            out = at if ready is None else max(at, ready - (self.burst - 1) * gap)
            ready = max(at, at if ready is None else ready) + gap
            on = max(0, on - 1)
            queue.append((out, at, event, agent, on))
        early = early[len(due) :]
        done = sorted(r for r in queue if r[0] // 1000 <= watermark_ms)
        queue = [r for r in queue if r[0] // 1000 > watermark_ms]
        self.early.put(early) if early else self.early.clear()
        self.queue.put(queue) if queue else self.queue.clear()
        next_ms = min([r[0] // 1000 for r in early] + [r[0] // 1000 for r in queue], default=None)
        if next_ms != timer:
            if timer is not None and timer > watermark_ms:
                self.handle.deleteTimer(timer)
            if next_ms is not None:
                self.handle.registerTimer(next_ms)
        self.link.update((ready, on, next_ms))
        if done:
            yield pd.DataFrame([(key[0], e, a, at, out, n) for out, at, e, a, n in done], columns=["edge_id", "event_id", "agent_id", "at_us", "out_us", "occupancy"])

    def close(self) -> None:
        pass


def released(events: DataFrame, burst: int = 2, late: str = "1 hour") -> DataFrame:
    """(edge_id, event_id, agent_id, at_us, out_us, occupancy): when each vehicle wants to leave its link and when it does, and how many are left on it.

    events: a stream of (ts, event_id, agent_id, edge_id, kind, gap_us); kinds other than enter and exit are passed over.
    """
    x = events.where("kind IN ('enter', 'exit')").withWatermark("ts", late)
    x = x.select("ts", "event_id", "agent_id", "edge_id", "gap_us", F.unix_micros("ts").alias("at_us"), (F.col("kind") == "enter").alias("enters"))
    return x.groupBy("edge_id").transformWithStateInPandas(Gate(burst), RELEASES, "Append", "EventTime")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query has dropped so far because they came behind the watermark."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
