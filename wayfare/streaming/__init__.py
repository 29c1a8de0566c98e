"""Groups by time over streams: an extension of the query language's groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(rows: DataFrame, time: str, width: str, keys: list[str], aggregates: dict[str, Column], *, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Aggregates by keys and windows of time: (start, stop, keys, aggregates).

    The same plan runs over a table and over a stream.  A stream forgets a window once the watermark, ``late`` behind
    the latest time seen, has passed its end; rows that come later are left out, so its state is bounded."""
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = rows.groupBy(window.alias("w"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, *aggregates)


def sessions(rows: DataFrame, time: str, gap: str, keys: list[str], aggregates: dict[str, Column], *, late: str = "10 minutes") -> DataFrame:
    """Aggregates by keys and sessions: rows of equal keys with less than ``gap`` between them."""
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    grouped = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, *aggregates)
