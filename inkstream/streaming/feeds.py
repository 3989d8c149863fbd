"""Change feeds and roll-ups on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stateful import changes  # noqa: F401  the stream whose batch twin is here


def changes_so_far(rows: DataFrame) -> DataFrame:
    """What :func:`changes` has emitted once all of a table's rows have come, in one batch."""
    w = Window.partitionBy("key").orderBy("ts", "payload")
    fresh = rows.withColumn("_before", F.lag("payload").over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col("payload"))).drop("_before")
    return fresh.select("key", "ts", "payload", F.row_number().over(w).cast("long").alias("change"))


def progress_feed(rows: DataFrame, key: str = "book_id") -> DataFrame:
    """Running counts per key for update mode."""
    return rows.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("state") == "complete").alias("complete"), F.count_if(F.col("state") == "failed").alias("failed"))


def windowed(rows: DataFrame, ts: str, key: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per time window and key; rows later than the watermark are left out on a stream."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, length), key).agg(F.count("*").alias("n"))
