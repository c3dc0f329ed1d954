"""Windows, sessions and deduplication over events; the same functions serve batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """Count and value by kind of event in windows that follow each other."""
    return sliding(events, size, size, late)


def sliding(events: DataFrame, size: str, step: str, late: str | None = None) -> DataFrame:
    """Count and value by kind of event in windows that overlap."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of each user: events less than `gap` apart."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """One event for each key; on a stream within the time events may be late."""
    if late:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)
