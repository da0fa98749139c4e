"""Incremental ingest: new files as a stream, each micro-batch through the batch operators once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions import text as T


def page_stream(spark: SparkSession, path: str, schema: str = "doc_id string, file_name string, page_num int, text_original string") -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.withColumn("file_type", T.file_type(F.col("path"))).withColumn("doc_id", F.sha2("content", 256))


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands everything that is new to `handle(batch, batch_id)`; the checkpoint remembers what was done.

    A batch may be handed over again after a failure: handlers write by (batch_id) or insert-or-ignore.
    """
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Watermarked counts of log-like events (ts, event_type) by window."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
