"""Operators that run on a stream as well as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_stream(df: DataFrame, keys: list[str], late: str = "2 hours", ts: str = "timestamp_utc") -> DataFrame:
    """One row of each key within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def resample_hourly_stream(df: DataFrame, value: str, late: str = "2 hours", ts: str = "timestamp_utc") -> DataFrame:
    """Hourly means by series, given out when the watermark passes an hour's end."""
    hour = F.window(ts, "1 hour")
    made = df.withWatermark(ts, late).groupBy("series_id", hour).agg(F.avg(value).alias(value), F.count("*").alias("n"))
    return made.select("series_id", F.col("window.start").alias(ts), value, "n")
