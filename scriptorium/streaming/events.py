"""Streams of events and documents: windows with watermarks, idempotent ingest, rolling spend."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder as a stream with the schema of a batch frame."""
    reader = spark.readStream.schema(like.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events per window and kind; rows later than the watermark are left out."""
    windows = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = events.withWatermark(ts, late).groupBy(windows.alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", ts: str = "ts", user: str = "user_id") -> DataFrame:
    """Sessions of a user: runs of events with no pause of ``gap``."""
    counted = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), user).agg(F.count("*").alias("n"))
    return counted.select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), user, "n")


def new_documents(docs: DataFrame, late: str = "1 day", ts: str = "seen_at") -> DataFrame:
    """Documents not seen within the watermark, by content hash and source."""
    hashed = docs.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    return hashed.withWatermark(ts, late).dropDuplicatesWithinWatermark(["content_hash", "source"])


def rolling_spend(calls: DataFrame, width: str = "1 day", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Cost per sliding window."""
    spent = calls.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w")).agg(F.sum("cost").alias("spent"))
    return spent.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "spent")


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process what is there now, a batch at a time, resuming from the checkpoint; ``each`` gets (frame, batch id)."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
