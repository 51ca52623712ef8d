"""Status events as a stream.

Both functions take a streaming (or static) DataFrame of events and keep state
that a watermark bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, *, at: str = "ts", kind: str = "event_type", window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(start, kind, n, total): events of each kind in each window; later than the watermark is dropped."""
    rows = events.withWatermark(at, late).groupBy(F.window(at, window), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), kind, "n", "total")


def idle_sessions(events: DataFrame, *, at: str = "ts", key: str = "user_id", gap: str = "7 days", late: str = "2 hours") -> DataFrame:
    """(key, start, end, n): sessions that a silence of ``gap`` ends."""
    rows = events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, *, at: str = "ts", key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Each event once; on a stream, as long as the watermark remembers it."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
