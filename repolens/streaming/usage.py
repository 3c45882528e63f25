"""Structured Streaming over usage facts: an extension, the batch engine has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_usage(usage: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Calls and tokens a tool and window; works on a stream (with a watermark) and on a batch."""
    w = F.window("called_at", window, slide) if slide else F.window("called_at", window)
    out = usage.withWatermark("called_at", late).groupBy(w.alias("w"), "tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_actual").alias("tokens_actual"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "tool", "calls", "tokens_actual")


def sessions(usage: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a project's calls that lie less than gap apart."""
    out = usage.withWatermark("called_at", late).groupBy(F.session_window("called_at", gap).alias("w"), "project").agg(F.count(F.lit(1)).alias("calls"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "project", "calls")
