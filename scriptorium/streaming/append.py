"""Append with resume as a stream: each input file is processed once, across restarts. Windows over time, in batches and as streams with state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.ordering import with_cell


def append_new(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Processes the parquet files that are new since the last call and appends the results; ends when there are no more."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return transform(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window and key; as a stream, rows later than `late` are dropped and windows are final once passed."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes", sums: dict[str, Column] | None = None) -> DataFrame:
    """keys, start, end (last row and the gap), n and sums of sessions: rows of a key of which each comes less than `gap` after the one before, or just at its end.

    As a stream, the open sessions of each key are state; rows later than `late` are dropped, and a session is final once the watermark passed its end.
    In a batch, rows are dealt by ranges of time as well as by key, so a key that holds a third of all rows is spread; the partial sessions of a key, one
    a range and session, are then joined where they touch. Null times and null keys: rows without a time are left out, a null key is a key.
    """
    added = {name: F.sum(value).alias(name) for name, value in (sums or {}).items()}
    session = F.session_window(time, gap)
    if events.isStreaming:
        found = events.withWatermark(time, late).groupBy(session.alias("w"), *keys).agg(F.count("*").alias("n"), *added.values())
        return found.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", *added)
    ranges = with_cell(events.where(F.col(time).isNotNull()).withColumn("__at", F.unix_micros(F.col(time).cast("timestamp"))), "__at")
    part = ranges.groupBy(session.alias("w"), "__cell", *keys).agg(F.count("*").alias("n"), *added.values()).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", *added)
    order = Window.partitionBy(*keys).orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = part.withColumn("__new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("__s", F.sum("__new").over(order))
    joined = opened.groupBy(*keys, "__s").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), *[F.sum(name).alias(name) for name in added])
    return joined.drop("__s")


def first_seen(events: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """Rows whose key was not seen before. As a stream, keys are remembered until the watermark passed their time, so repeats that come later than `late` after it are new."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
