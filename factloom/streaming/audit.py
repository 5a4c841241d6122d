"""A streaming roll-up of audit events by type and window, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n, cost of events (occurred_at, event_type, estimated_cost_usd); batch or streaming."""
    events = events.withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    d = events.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", window), "event_type")
    return d.agg(F.count("*").alias("n"), F.sum(F.coalesce("estimated_cost_usd", F.lit(0.0))).alias("cost")).select(F.col("window.start").alias("window_start"), "event_type", "n", "cost")
