"""Streaming forms of the daily and weekly summaries: an extension, since all inputs of the batch operators are closed archives.

The same aggregation runs on a stream; the watermark bounds its state, and rows later than it are left out of closed windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """A watermark needs an instant; a batch keeps its own timestamps and has no late rows."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if stream.isStreaming else stream


def daily_summary(stream: DataFrame, ts: str = "ts", node: str = "user_id", value: str = "value", late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Mean, extremes and count per node and tumbling window."""
    w = F.window(ts, width)
    return _timed(stream, ts, late).groupBy(w, node).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n")).select(F.col("window.start").alias("start"), node, "mean", "low", "high", "n")


def sessions(stream: DataFrame, ts: str = "ts", node: str = "user_id", gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """Stretches of a node's rows with no pause longer than `gap`."""
    w = F.session_window(ts, gap)
    return _timed(stream, ts, late).groupBy(w, node).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), node, "n")
