"""Structured Streaming forms of the tumbling and rolling operators, for recordings that arrive as events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_statistics(events: DataFrame, keys: Sequence[str], value: str, time: str = "ts", size: str = "60 seconds", slide: str | None = None, late: str = "5 minutes") -> DataFrame:
    """keys, start, n, mean, min, max, rms of event-time windows; rows later than the watermark are dropped.

    Works on batch frames too, where the watermark has no effect.
    """
    window = F.window(time, size, slide) if slide else F.window(time, size)
    x = F.col(value)
    out = events.withWatermark(time, late).groupBy(*keys, window.alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.sqrt(F.avg(x * x)).alias("rms"))
    return out.select(*keys, F.col("w.start").alias("start"), "n", "mean", "min", "max", "rms")


def phase_sessions(events: DataFrame, keys: Sequence[str], gap: str = "10 minutes", time: str = "ts", late: str = "5 minutes") -> DataFrame:
    """keys, start, end, n of stretches without a gap."""
    out = events.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
