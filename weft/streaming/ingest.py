"""Streams: incremental import of files, and deduplication of events."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.sources.writers import append_batch


def import_files(spark: SparkSession, folder: str, schema: str, table: str, key: list[str], checkpoint: str):
    """Import the folder's new JSON-lines files once; records already stored are skipped.

    The checkpoint numbers the batches and remembers their files; a batch that runs again
    after a failure replaces what it wrote, so every key is stored once.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    stream = spark.readStream.schema(schema).json(folder)
    query = stream.writeStream.foreachBatch(lambda batch, number: append_batch(batch, f"{name}-{number}", table, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def distinct_events(events: DataFrame, key: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events without repetitions of their key within the watermark; for streams and batches."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
    return events.dropDuplicates(key)


def windows(events: DataFrame, width: str = "1 hour", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Per window and event type: events and the sum of values."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
