"""Event-time windows and sessions; the same functions serve batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str, slide: str | None = None, late: str | None = None, by: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums per window (sliding if `slide` is given) and key; `late` sets a watermark on streams."""
    df = events.withWatermark(ts, late) if late else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None, by: str = "user_id", ts: str = "ts") -> DataFrame:
    df = events.withWatermark(ts, late) if late else events
    return df.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_keys(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """First row of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
