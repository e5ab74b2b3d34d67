"""Connected components by alternating stars, and the written tables that cut the lineage of loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset a temporary one serves a local session; a cluster must name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tramline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    return _placed(df, name)[0]


def _placed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tramline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Steps:
    """Written tables of a loop, of which only the last ``held`` are kept."""

    def __init__(self, spark: SparkSession, held: int = 2):
        self.spark, self.held, self.paths = spark, held, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _placed(df, name)
        self.paths.append(path)
        while len(self.paths) > self.held:
            self._delete(self.paths.pop(0))
        return out

    def clear(self) -> None:
        """Deletes what is left, once nothing reads it any more."""
        while self.paths:
            self._delete(self.paths.pop())

    def _delete(self, path: str) -> None:
        deleted(self.spark, path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join in a loop: matched in the executors, as a table sent to all of them would pass the driver in every round."""
    return df.hint("merge")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by columns over three tasks a core: for rows that are few bytes and much work, which adaptive execution would put into one task."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *by)


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 100, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, component): for each node of an edge the least node it can reach. Direction does not count; loops and repeats do no harm. With ``by`` several networks are searched side by side.

    Large-star and small-star steps in turn (Kiveris et al. 2014): each links nodes to the least neighbour they know, so that
    after some rounds, about the logarithm of the longest path, only stars are left. No node's neighbours are ever gathered in
    one row; a hub costs a skewed join that adaptive execution splits.
    """
    keys = list(by)
    steps = Steps(edges.sparkSession)
    edges = steps.keep(edges.select(*keys, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and u <> v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(shuffled(least), [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(shuffled(least), [*keys, "u"]).where("v > m").select(*keys, F.col("m").alias("v"), F.col("v").alias("u"))
        edges = steps.keep(small.unionByName(least.select(*keys, "u", F.col("m").alias("v"))).distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = edges.select(*keys, F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(*keys, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
