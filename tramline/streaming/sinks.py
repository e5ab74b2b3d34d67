"""A sink of batches that may be written again.

Each batch of a stream has a folder by its number and overwrites what is there. A batch that was written before its query ended and is
run again after a restart so leaves its rows once, which appending would not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def into_folders(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the batch as Parquet under ``path``."""

    def keep(frame: DataFrame, batch: int) -> None:
        frame.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return keep


def started(out: DataFrame, path: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Writes the stream ``out`` to ``path``/out, with its state in ``path``/state: a batch ``every`` so often ("5 minutes"), or, without that, all that is there and then no more.

    A query that is started again with the same path goes on where it ended.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = out.writeStream.outputMode(mode).foreachBatch(into_folders(f"{path}/out"))
    return writer.option("checkpointLocation", f"{path}/state").trigger(**trigger).start()


def taken(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``started`` has written to ``path``; empty before its first batch."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("basePath", f"{path}/out").parquet(f"{path}/out/batch=*").select(*schema.names)
    except AnalysisException:
        return spark.createDataFrame([], schema)
