"""The weekly count as a stream: an addition, the batch form is ``operators.counting``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_counts(events: DataFrame, late: str = "14 days") -> DataFrame:
    """(week, event_type, n) in windows of seven days that begin on Mondays; rows later than ``late`` are dropped."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    week = F.window("ts", "7 days", "7 days", "4 days")
    return stamped.groupBy(week, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("date").alias("week"), "event_type", "n")
