"""Bars from streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.bars import FIXED_MS, MONDAY


def stream_bars(events: DataFrame, interval: str, late: str = "1 hour", source: str = "event_type", ts: str = "ts", price: str = "value", slide: str | None = None) -> DataFrame:
    """Bars of a stream (or table) of events, each emitted once the watermark has passed its close; repeated events count once.

    slide: a shorter interval from which a bar of `interval` opens each time. Weeks open on Mondays. Months have no fixed
    length: their bars open at a truncated date, and a stream emits them in update mode.
    """
    rows = events.withWatermark(ts, late).dropDuplicates(["event_id", ts])
    at = F.struct(ts, "event_id", price)
    if interval == "1M":
        bucket = F.struct(F.date_trunc("MONTH", ts).alias("start"))
    else:
        seconds = lambda ms: f"{ms // 1000} seconds"
        bucket = F.window(ts, seconds(FIXED_MS[interval]), seconds(FIXED_MS[slide or interval]), seconds(MONDAY) if interval == "1w" else None)
    out = rows.groupBy(bucket.alias("window"), F.col(source).alias("source")).agg(
        F.min(at)[price].alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max(at)[price].alias("close"), F.count("*").cast("double").alias("volume"),
    )
    return out.select("source", F.unix_millis(F.col("window.start").cast("timestamp")).alias("time"), "open", "high", "low", "close", "volume")
