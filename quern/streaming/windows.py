"""Event-time windows, sessions and de-duplication, on batch or streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def late(frame: DataFrame, time: str, delay: str) -> DataFrame:
    """A watermark; without effect on batch frames."""
    return frame.withWatermark(time, delay) if frame.isStreaming else frame


def tumbling(frame: DataFrame, time: str, size: str, keys: list[str], delay: str = "1 hour", slide: str | None = None, **named) -> DataFrame:
    """Aggregates per key and window: name=(column, function of a column)."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = late(frame, time, delay).groupBy(w.alias("w"), *keys).agg(*[f(c).alias(n) for n, (c, f) in named.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *named)


def sessions(frame: DataFrame, time: str, gap: str, keys: list[str], delay: str = "1 hour", **named) -> DataFrame:
    out = late(frame, time, delay).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*[f(c).alias(n) for n, (c, f) in named.items()])
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *named)


def distinct_events(frame: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    if frame.isStreaming:
        return frame.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return frame.dropDuplicates(keys)
