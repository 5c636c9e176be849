"""Windowed counts and deduplication over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, *, late: str = "1 hour", window: str = "6 hours") -> DataFrame:
    """Counts and sums by type and window; `ts` must be a timestamp."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_seen(events: DataFrame, identity: str, *, late: str = "1 hour") -> DataFrame:
    """The first row of each identity within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([identity])
