"""Progress events as a stream of JSON files: counts per event type, in batch and streaming.

The file source does not follow a file that grows, so events are appended as new files, one per batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts double, event string, payload string"


def progress(events: DataFrame) -> DataFrame:
    """ts (seconds since 1970), event and payload of the events table."""
    return events.select((F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000.0)).alias("ts"), F.col("event_type").alias("event"), F.col("props").cast("string").alias("payload"))


def emit(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)


def counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """An extension: counts per event and hour, closed once the watermark has passed."""
    at = events.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return at.groupBy(F.window("at", "1 hour").alias("w"), "event").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event", "n")
