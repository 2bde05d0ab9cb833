"""Windowed counts over the event stream. An extension: the engine's batch operators do not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows per type: count and sum; works on streams (with a watermark) and on tables alike."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    g = marked.groupBy(F.window(ts, length).alias("w"), kind).agg(F.count("*").alias("n_events"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n_events", "total")


def deduplicated(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each event once, within the watermark on streams."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
