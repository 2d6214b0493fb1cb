"""Streaming forms of the session and popularity features, an extension of the batch definitions.

Late events beyond the watermark are dropped, which the batch definitions have no counterpart for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_counts(events: DataFrame, *, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Clicks and events per user session of a stream (columns ts, user_id, event_type)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum((F.col("event_type") == "click").cast("int")).alias("clicks")
    )


def article_counts(events: DataFrame, *, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Clicks per article and tumbling window of a stream (columns ts, event_type, article_id)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.where("event_type = 'click'").groupBy(F.window("ts", window).alias("window"), "article_id").agg(
        F.count(F.lit(1)).alias("clicks")
    )
