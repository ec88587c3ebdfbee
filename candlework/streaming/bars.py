"""Bars from an event stream: an extension, as the engine itself is batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_bars(events: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Open, high, low, close and count of ``value`` per event type and window; late rows wait for the watermark."""
    order = F.struct("ts", "event_id")
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", every), F.col("event_type").alias("ticker"))
        .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("trade_count"))
        .select("ticker", F.to_date("window.start").alias("trade_date"), "open", "high", "low", "close", "trade_count")
    )
