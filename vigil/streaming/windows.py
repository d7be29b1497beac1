"""Event-time windows over the events stream: our own additions, batch and stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _counts(events: DataFrame, window) -> DataFrame:
    grouped = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def tumbling(events: DataFrame, size: str = "1 day", late: str | None = None) -> DataFrame:
    return _counts(events.withWatermark("ts", late) if late else events, F.window("ts", size))


def sliding(events: DataFrame, size: str = "1 day", slide: str = "12 hours", late: str | None = None) -> DataFrame:
    return _counts(events.withWatermark("ts", late) if late else events, F.window("ts", size, slide))


def sessions(events: DataFrame, gap: str = "2 hours", late: str | None = None) -> DataFrame:
    """A user's runs of events without a longer gap."""
    rows = events.withWatermark("ts", late) if late else events
    grouped = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), "user_id", "n")


def once(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Each key's first event within the allowed delay."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
