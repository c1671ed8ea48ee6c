"""A streaming form of the crawl's deduplication and of a running tally, beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh_entries(entries: DataFrame, time: str = "fetched", keys: tuple[str, ...] = ("section", "url"), late: str = "7 days") -> DataFrame:
    """Each address of a section once within the watermark; state older than that is forgotten."""
    return entries.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key and window, final once the watermark has passed."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width), key)
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
