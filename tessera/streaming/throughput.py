"""Streams of deliveries: re-deliveries dropped and throughput by hour, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "2 hours"


def first_deliveries(stream: DataFrame, key: list[str], ts: str = "ts", late: str = LATE) -> DataFrame:
    """Rows whose key did not come before within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def hourly(stream: DataFrame, by: list[str], ts: str = "ts", late: str = LATE) -> DataFrame:
    """(hour, *by, n) in tumbling windows; works on a batch too."""
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("hour"), *by, "n")
