"""Windowed aggregation, the same on a static and on a streaming frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How late a record may come on a stream before its window is closed.
LATENESS = "2 hours"


def _counted(df: DataFrame, at: str, key: str, window: Column, lateness: str) -> DataFrame:
    rows = df.where(F.col(at).isNotNull())
    if df.isStreaming:
        rows = rows.withWatermark(at, lateness)
    out = rows.groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "total")


def tumbling(df: DataFrame, at: str, key: str, length: str, lateness: str = LATENESS) -> DataFrame:
    """(window_start, key, n, total of ``value``); rows without time are left out."""
    return _counted(df, at, key, F.window(at, length), lateness)


def sliding(df: DataFrame, at: str, key: str, length: str, step: str, lateness: str = LATENESS) -> DataFrame:
    return _counted(df, at, key, F.window(at, length, step), lateness)


def sessions(df: DataFrame, at: str, key: str, gap: str, lateness: str = LATENESS) -> DataFrame:
    """(key, session_start, session_end, n): runs of rows with less than ``gap`` between them; the end is the last time plus the gap."""
    rows = df.where(F.col(at).isNotNull() & F.col(key).isNotNull())
    if df.isStreaming:
        rows = rows.withWatermark(at, lateness)
    out = rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
