"""Streams of events: session windows with a watermark, sliding window scores, and first-seen deduplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events from Parquet files as they come, with `ts` as an instant."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def gap_sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Per user: sessions that end after `gap` without events; rows later than `late` are dropped."""
    by = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total")


def sliding_scores(events: DataFrame, width: str = "6 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and means by role in sliding windows."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each key once; keys are forgotten after `late`."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def to_batches(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Runs the stream over what is there, calling write(batch, number) once per micro-batch."""
    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
