"""Stateful behaviours over an event log, as Structured Streaming jobs.

The same functions serve batch and streaming frames; `drain` runs a stream over what has arrived and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 4) -> DataFrame:
    """A rate-limited stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def daily_counts(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    """Events per key and calendar day; state of a day is dropped once the watermark has passed it."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(time, late)
    return timed.groupBy(*keys, F.window(time, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("day"), "n")


def over_quota(counts: DataFrame, limit: int) -> DataFrame:
    """Keys and days whose count passes the limit, and by how much."""
    return counts.where(F.col("n") > limit).withColumn("rejected", F.col("n") - limit)


def latest_state(events: DataFrame, key: str, time: str, order: str, state: str) -> DataFrame:
    """key and the state of its last event; one struct of state per key."""
    return events.groupBy(key).agg(F.max(F.struct(time, order, state)).alias("last")).select(key, F.col(f"last.{state}").alias(state))


def once(events: DataFrame, identity: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    """Events without repeats of an identity that arrive within the lateness."""
    if not events.isStreaming:
        return events.dropDuplicates(identity)
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(identity)


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that has arrived, into an in-memory table; for tests and small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def drain_batches(df: DataFrame, checkpoint: str, handle, interval: str | None = None):
    """Hand each micro-batch to handle(frame, batch_id): all that has arrived, or on and on at an interval such as `30 seconds`.

    A batch that is handed over again after a failure has its old id, so a handler that writes by id writes it once.
    """
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def append_log(df: DataFrame, folder: str, checkpoint: str):
    """Append a stream to a folder of Parquet files, each event once."""
    return df.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
