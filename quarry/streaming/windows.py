"""Stream jobs on event time: latency windows, sessions, first acknowledgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    """Counts and means of value by sliding window and event type; rows later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select("window.start", "window.end", "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "45 seconds", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with no gap of that length between them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_of_each(acks: DataFrame, key: str, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first row of each key: later acknowledgements within the watermark change nothing."""
    return acks.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts a query that writes what has arrived to Parquet, exactly once, and ends."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
