"""Streams: files as they arrive, and event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, length: str, slide: str | None = None, late: str = "10 minutes", keys: list[str] | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates over tumbling or sliding windows; rows later than `late` are left out of a stream."""
    src = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, length, slide) if slide else F.window(time, length)
    got = src.groupBy(w.alias("w"), *(keys or [])).agg(*(c.alias(n) for n, c in aggregates.items()))
    return got.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(keys or []), *aggregates)


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str = "10 minutes", **aggregates: Column) -> DataFrame:
    """Aggregates over sessions: runs of a key's events with no gap longer than `gap`."""
    src = events.withWatermark(time, late) if events.isStreaming else events
    got = src.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return got.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *aggregates)


def once(events: DataFrame, time: str, *ids: str, late: str = "10 minutes") -> DataFrame:
    """Each id once; a stream remembers ids for as long as rows may be late."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(ids)) if events.isStreaming else events.dropDuplicates(list(ids))
