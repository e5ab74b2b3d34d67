"""Dense numbers in a global order, and rows from counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import spread, written


def dense_ids(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with 0, 1, 2 ... in the order of columns that together are unique.

    Rows are dealt by range and numbered within their range; offsets come from one row a range. No task sees more than a range.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_rank", rank).join(F.broadcast(sizes), "_part").withColumn(name, F.col("_rank") + F.col("_before")).drop("_part", "_rank", "_before")


#: Copies of a row that one row is asked for at most.
CHUNK = 10_000


def repeated(df: DataFrame, count: str, index: str) -> DataFrame:
    """Each row as often as its ``count`` says, numbered from 0 in ``index``; none for a count under 1.

    Few rows may become very many, so they are cut into chunks, which are dealt over the tasks before their rows are made.
    """
    n = F.col(count).cast("int")
    chunks = df.where(F.col(count) >= 1).withColumn("_chunk", F.explode(F.sequence(F.lit(0), ((n - 1) / CHUNK).cast("int"))))
    dealt = spread(chunks, *chunks.columns)
    first = F.col("_chunk") * CHUNK
    return dealt.withColumn(index, F.explode(F.sequence(first, F.least(n, first + CHUNK) - 1))).drop("_chunk")
