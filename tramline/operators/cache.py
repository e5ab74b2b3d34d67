"""What a route cache of bounded size would have answered, over a table of requests in order.

The cache takes in what it is asked for and does not have, and lets go what it took in first: an entry lasts until ``capacity`` more
have been taken in, and asking for it does not make it last longer. So a request is a miss if its key was never taken in before, or if since
then there were ``capacity`` misses or more. That needs the number of misses before each request, which the misses themselves
make up: it is found by going over all requests again until nothing changes. What is right up to a request makes the next one right,
so the end is the one that a step-by-step cache reaches; where entries last for long it takes a few rounds.

A round adds up misses in blocks of the order, then over the blocks, and goes through each key's requests in order; no task sees more than a
block, or more than one row of a key at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import Steps, written
from .numbering import dense_ids

BLOCK = 1 << 16


def _misses_before(flags: DataFrame, block: int) -> DataFrame:
    """``flags`` (t, first, miss) with the misses before each t."""
    rows = flags.withColumn("block", F.floor(F.col("t") / block))
    sums = rows.groupBy("block").agg(F.sum("miss").alias("n"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    sums = sums.select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(sums, "block").select("t", "first", "miss", (F.col("base") + F.coalesce(F.sum("miss").over(inside), F.lit(0))).alias("before"))


def _asked_again(capacity: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and t: t, first, miss, before."""
        key, taken = None, 0
        for batch in batches:
            first, before = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            new = np.zeros(len(first), np.int32)
            for i, (k, n) in enumerate(zip(first, before, strict=True)):
                if k != key or n - taken - 1 >= capacity:
                    key, taken, new[i] = k, n, 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(new)], ["t", "first", "miss", "new"])

    return each


def outcomes(requests: DataFrame, order: list[str], key: list[str], capacity: int = 500_000, rounds: int = 10_000, block: int = BLOCK) -> DataFrame:
    """``requests`` with t (their place by ``order``, whose columns together are unique) and hit. Null parts of a key are equal to each other."""
    if capacity < 1:
        raise ValueError("a cache holds one route at least")
    placed = written(dense_ids(requests, "t", *order), "placed")
    names = F.struct(*key)
    first = placed.groupBy(names.alias("_k")).agg(F.min("t").alias("first"))
    flags = placed.select("t", names.alias("_k")).join(first, "_k").select("t", "first", (F.col("t") == F.col("first")).cast("int").alias("miss"))
    steps = Steps(requests.sparkSession)
    flags = steps.keep(flags, "flags")
    for _ in range(rounds):
        rows = _misses_before(flags, block).repartition("first").sortWithinPartitions("first", "t")
        both = steps.keep(rows.mapInArrow(_asked_again(capacity), "t long, first long, miss int, new int"), "flags")
        if both.where("miss <> new").isEmpty():
            return placed.join(both.select("t", (F.col("miss") == 0).alias("hit")), "t")
        flags = both.select("t", "first", F.col("new").alias("miss"))
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def statistics(found: DataFrame, capacity: int = 500_000) -> DataFrame:
    """One row: requests, hits, misses, evictions, entries at the end."""
    x = found.agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    misses = F.col("n") - F.col("hits")
    return x.select("n", "hits", misses.alias("misses"), F.greatest(misses - capacity, F.lit(0)).alias("evictions"), F.least(misses, F.lit(capacity)).alias("entries"))


def invalidated(routes: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cached ``routes`` (edges array) that stay, and those that go because an edge of ``changed`` (edge_id) is on them."""
    keyed = routes.withColumn("_row", F.xxhash64(F.to_json(F.struct(*routes.columns))))
    hit = keyed.select("_row", F.explode("edges").alias("edge_id")).join(changed.select("edge_id").distinct(), "edge_id", "left_semi").select("_row").distinct()
    return keyed.join(hit, "_row", "left_anti").drop("_row"), keyed.join(hit, "_row", "left_semi").drop("_row")
