"""Trace events as a stream: windowed counts with late data, and appends of new artifacts once each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Per window and kind: events and their sum; state older than `late` is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def once(events: DataFrame, key: str, time: str = "ts", late: str = "30 minutes") -> DataFrame:
    """Each key once inside the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
