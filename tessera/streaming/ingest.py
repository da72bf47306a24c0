"""Incremental ingest with Structured Streaming, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of a folder as they arrive; back-pressure by files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_each(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the delay."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Feed micro-batches to a sink; all that is there and then end, or on a schedule such as "1 hour"."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def new_slides(batch: DataFrame, ledger: DataFrame, key: str = "wsi_name") -> DataFrame:
    """Rows of slides that the ledger does not have yet."""
    return batch.join(ledger.select(key).distinct(), key, "left_anti")


def missing_indexes(batches: DataFrame, indexed: DataFrame, key: str = "batch_id") -> DataFrame:
    return batches.join(indexed.select(key).distinct(), key, "left_anti")


def tumbling(events: DataFrame, width: str, *by: str, slide: str | None = None, time: str = "ts") -> DataFrame:
    """window_start, by, n, total of event-time windows."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return e.groupBy(w.alias("_w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("_w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, *by: str, time: str = "ts") -> DataFrame:
    """by, session_start, n: runs of events with less than the gap between neighbours."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    return e.groupBy(*by, F.session_window(time, gap).alias("_w")).agg(F.count("*").alias("n"), F.max(time).alias("last")).select(*by, F.col("_w.start").alias("session_start"), "last", "n")
