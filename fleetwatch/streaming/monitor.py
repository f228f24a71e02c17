"""Operational metrics over scored records, for batch and streaming frames.

Rates are event-time sliding windows: per-second request and anomaly rates over
``width`` windows every ``slide``.  Counts of parts of the rows add up to the counts of all.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, SLIDE, WIDTH_SECONDS = "1 hour", "15 minutes", 3600.0


def window_counts(scored: DataFrame, ts: str = "ts", width: str = WIDTH, slide: str = SLIDE) -> DataFrame:
    g = scored.groupBy(F.window(ts, width, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("anomaly_flag") == -1).alias("anomalies"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests", "anomalies")


def rates(counts: DataFrame, width_seconds: float = WIDTH_SECONDS) -> DataFrame:
    return counts.select("window_start", "requests", "anomalies",
                         (F.col("requests").cast("double") / F.lit(width_seconds)).alias("request_rate"),
                         (F.col("anomalies").cast("double") / F.lit(width_seconds)).alias("anomaly_rate"))


def rate_windows(scored: DataFrame, ts: str = "ts", width: str = WIDTH, slide: str = SLIDE,
                 width_seconds: float = WIDTH_SECONDS) -> DataFrame:
    return rates(window_counts(scored, ts, width, slide), width_seconds)


def counter_totals(scored: DataFrame) -> DataFrame:
    """Global running totals (``complete`` mode on a stream)."""
    return scored.agg(F.count(F.lit(1)).alias("requests_total"),
                      F.count_if(F.col("anomaly_flag") == -1).alias("anomalies_total"))
