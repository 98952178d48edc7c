"""Streams: an extension of the batch tables for the two inputs that grow by appending, audit lines and new editions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need instants: local timestamps are taken as UTC (the session's zone)."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def daily_counts(events: DataFrame, ts: str = "ts", action: str = "event_type", late: str = "1 hour") -> DataFrame:
    """Lines by day and action; the same expression for a stream and a batch."""
    d = timed(events, ts)
    d = d.withWatermark(ts, late) if d.isStreaming else d
    return d.groupBy(F.window(ts, "1 day").alias("w"), F.col(action)).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("dia"), action, "n")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    d = timed(events, ts)
    d = d.withWatermark(ts, late) if d.isStreaming else d
    return d.groupBy(F.session_window(ts, gap).alias("s"), F.col(user)).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("s.start").alias("inicio"), F.col("s.end").alias("fim"), "n")


def without_repeats(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    d = timed(events, ts)
    return d.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if d.isStreaming else d.dropDuplicates(keys)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Handles all that is there and stops; run again, it goes on where it stopped."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def drain_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> None:
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
