"""Streams that are cut, late or run again."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tramline.streaming import gates, sinks

SCHEMA = "ts timestamp, event_id long, agent_id long, edge_id long, kind string, gap_us long"
HOUR = 3_600_000_000


@pytest.fixture
def store(spark):
    before = spark.conf.get(gates.STORE[0])
    spark.conf.set(*gates.STORE)
    yield
    spark.conf.set(gates.STORE[0], before)


def events(n=400, edges=5):
    """(at_us, event, agent, edge, kind, gap): crowded enough that many wait; with ties."""
    r = random.Random(3)
    return [((1_700_000_000 + r.randrange(40) * 300 + r.choice([0, 0, 1])) * 1_000_000 + r.choice([0, 250]), i, r.randrange(50), e := r.randrange(edges), r.choice(["enter", "exit", "exit", "arrive"]), (200 + 100 * e) * 1_000_000) for i in range(n)]


def files(spark, path, parts):
    for i, rows in enumerate(parts):
        df = spark.createDataFrame([(at, *x) for at, *x in rows], "at long, event_id long, agent_id long, edge_id long, kind string, gap_us long")
        df.select(F.timestamp_micros("at").alias("ts"), "event_id", "agent_id", "edge_id", "kind", "gap_us").coalesce(1).write.mode("append").parquet(f"{path}/{i:02d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def run(spark, stream, path, **options):
    out = gates.released(stream, **options)
    q = sinks.started(out, path)
    q.awaitTermination()
    return sorted(tuple(r) for r in sinks.taken(spark, path, out.schema).collect()), gates.late_rows(q)


def brute(rows, burst, late_us):
    """One link after the other, one event after the other: permits are a number that grows with time up to ``burst``."""
    rows = [r for r in rows if r[4] in ("enter", "exit")]
    until = max(r[0] for r in rows) // 1000 - late_us // 1000
    out = []
    for edge in {r[3] for r in rows}:
        on, have, since = 0, None, None
        for at, event, agent, _, kind, gap in sorted(r for r in rows if r[3] == edge):
            if at // 1000 > until:
                continue
            if kind == "enter":
                on += 1
                continue
            # Permits in units of 1 / gap; ``have`` may be below 0 while others still wait.
            have = burst * gap if have is None else min(burst * gap, have + at - since)
            since = at
            have -= gap
            on = max(0, on - 1)
            left = at + max(0, -have)
            if left // 1000 <= until:
                out.append((edge, event, agent, at, left, on))
    return sorted(out)


def test_gates_give_the_same_rows_however_files_are_cut(spark, store, tmp_path):
    rows = events()
    want = brute(rows, 2, HOUR)
    assert sum(out > at for _, _, _, at, out, _ in want) > 30
    one, _ = run(spark, files(spark, f"{tmp_path}/one", [rows]), f"file://{tmp_path}/a")
    assert one == want
    r = random.Random(5)
    mixed = sorted(rows, key=lambda x: x[0] + r.randrange(HOUR // 3))  # ten files, out of order by less than the watermark allows
    ten, late = run(spark, files(spark, f"{tmp_path}/ten", [mixed[i * 40 : i * 40 + 40] for i in range(10)]), f"file://{tmp_path}/b")
    assert ten == want and late == 0


def test_late_rows_are_counted(spark, store, tmp_path):
    rows = [x for x in events(200, 2) if x[4] == "exit"]
    first = min(x[0] for x in rows)
    new = [x for x in rows if x[0] > first + 2 * HOUR]
    old = [x for x in rows if x[0] < first + HOUR // 2]
    # Rows count as late by the watermark of the batch before theirs.
    last = max(new)
    got, late = run(spark, files(spark, f"{tmp_path}/in", [[last], [x for x in new if x != last and x[0] > last[0] - HOUR // 6], old]), f"file://{tmp_path}/c", late="10 minutes")
    new = [x for x in new if x[0] > last[0] - HOUR // 6]
    assert got == brute(new, 2, HOUR // 6) and late == len(old) > 0


def test_a_batch_that_runs_again_leaves_its_rows_once(spark, tmp_path, monkeypatch):
    """The query ends after a batch is written and before it is noted as done; it is started again."""
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    stream = files(spark, f"{tmp_path}/in", [events()[i * 100 : i * 100 + 100] for i in range(4)])
    out = stream.select("event_id", "edge_id")
    plain, calls = sinks.into_folders, []

    def broken(where):
        keep = plain(where)

        def once(frame, batch):
            keep(frame, batch)
            calls.append(batch)
            if batch == 2 and calls.count(2) == 1:
                raise RuntimeError("killed")

        return once

    monkeypatch.setattr(sinks, "into_folders", broken)
    with pytest.raises(Exception, match="killed"):
        sinks.started(out, path).awaitTermination()
    assert sinks.taken(spark, path, out.schema).count() == 300
    sinks.started(out, path).awaitTermination()
    assert calls == [0, 1, 2, 2, 3]
    got = [r["event_id"] for r in sinks.taken(spark, path, out.schema).collect()]
    assert sorted(got) == list(range(400))


def test_a_sink_by_the_clock_goes_on_until_it_is_stopped(spark, tmp_path):
    out = files(spark, f"{tmp_path}/in", [events()[:50]]).select("event_id")
    q = sinks.started(out, f"file://{tmp_path}/d", every="1 second")
    q.processAllAvailable()
    assert q.isActive and sinks.taken(spark, f"file://{tmp_path}/d", out.schema).count() == 50
    q.stop()
    assert sinks.taken(spark, f"file://{tmp_path}/none", out.schema).count() == 0
