"""Usage counts that grow with a stream of calls. The batch engine needs none of this."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(calls: DataFrame) -> DataFrame:
    """Counts per function of a stream of calls (function_id), for update or complete mode."""
    return calls.groupBy("function_id").agg(F.count("*").alias("n"))


def windowed_counts(calls: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts", key: str = "function_id") -> DataFrame:
    """Counts per key and window of event time; rows later than the watermark are dropped, so state stays bounded."""
    kept = calls.withWatermark(time, late)
    return kept.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(calls: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts", key: str = "user_id") -> DataFrame:
    """Runs of a key's rows that are no further apart than the gap."""
    kept = calls.withWatermark(time, late)
    return kept.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
