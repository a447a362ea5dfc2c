"""Snapshots as a stream: at most one a pair and day, late repeats within the watermark dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_snapshots(stream: DataFrame, key: list[str], delay: str = "1 day") -> DataFrame:
    """stream(key, captured_at, position) with snapshot_date, the first of each pair and UTC day."""
    dated = stream.withColumn("snapshot_date", F.to_date("captured_at")).withWatermark("captured_at", delay)
    return dated.dropDuplicatesWithinWatermark([*key, "snapshot_date"])


def update_counts(stream: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """How many captures, and how many without a position, each window of a stream has."""
    return stream.withWatermark("captured_at", delay).groupBy(F.window("captured_at", window).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("position").isNull()).alias("unranked")).select(F.col("w.start").alias("start"), "n", "unranked")
