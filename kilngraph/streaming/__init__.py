"""Structured Streaming counterparts: edges that arrive as a stream, counted in event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Rows of each key in event-time windows; works on a stream (rows later than `late` are dropped) and on a table."""
    held = events.withWatermark(time, late) if events.isStreaming else events
    out = held.groupBy(F.window(time, width).alias("window"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def first_seen(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """Each key's first event within the watermark."""
    held = events.withWatermark(time, late) if events.isStreaming else events
    return held.dropDuplicatesWithinWatermark(keys) if events.isStreaming else held.groupBy(*keys).agg(F.min(time).alias(time))


def decayed(value: Column, age_s: Column, half_life_s: float) -> Column:
    return value * F.pow(F.lit(0.5), age_s / half_life_s)
