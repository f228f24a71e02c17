"""Fleet and unit dashboards over the results table.

Every report is computed for all units at once.  Per-unit figures are partial
(map-side) aggregates — ``count``, ``count_if``, ``max`` and ``max_by`` — so a
hot unit never has to sit in one task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import decisions as D
from ..functions.numeric import clip, round_exact, truncate_text
from .ordered import top_k_per_unit

STATUS_FIELDS = ["time_cycle", "RUL", "predicted_RUL", "anomaly_score", "anomaly_flag",
                 "recommended_action", "risk_score", "confidence"]


def fleet_kpis(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col("anomaly_flag") == -1).alias("detected_anomalies"),
        F.count_if(F.col("anomaly_flag") == 1).alias("normal_records"),
        F.count_if(D.is_critical("recommended_action")).alias("critical_cases"))


def value_counts(df: DataFrame, value, name: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """Frequency of each non-null value (pandas ``value_counts``), of all rows or for each ``by``
    (the dashboard's selected unit, for all units at once)."""
    v = F.col(value) if isinstance(value, str) else value
    return (df.select(*by, v.alias(name)).where(F.col(name).isNotNull())
            .groupBy(*by, name).agg(F.count(F.lit(1)).alias("n")))


def risk_histogram(df: DataFrame, risk: str = "risk_score", bins: int = C.RISK_HISTOGRAM_BINS, by: tuple[str, ...] = ()) -> DataFrame:
    """Fixed ``bins`` equal bins on [0, 1], of all rows or for each ``by``; the last bin is closed."""
    b = F.least(F.floor(F.col(risk) * bins), F.lit(bins - 1)).cast("long")
    return (df.where(F.col(risk).isNotNull()).select(*by, b.alias("bin"))
            .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("bin_low", F.col("bin") / F.lit(float(bins)))
            .withColumn("bin_high", (F.col("bin") + 1) / F.lit(float(bins))))


CONFIDENCE_GROUP = ["risk_score", "confidence"]


def has_group(df: DataFrame, group: list) -> bool:
    """Plan-time presence check of an optional column group (no job)."""
    return all(c in df.columns for c in group)


def unit_status(df: DataFrame) -> DataFrame:
    """Status panel of every unit: latest row + health, alert, failure risk, risk band.

    Without the confidence group (risk, confidence) those fields are NULL."""
    if not has_group(df, CONFIDENCE_GROUP):
        df = df.withColumns({"risk_score": F.lit(None).cast("double"), "confidence": F.lit(None).cast("string")})
    latest = F.max_by(F.struct(*[F.col(c) for c in STATUS_FIELDS]), "time_cycle")
    u = df.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("unit_records"),
        F.count_if(F.col("anomaly_flag") == -1).alias("unit_anomalies"),
        F.max("RUL").alias("_max_rul"),
        latest.alias("_l"))
    max_rul = F.greatest(F.col("_max_rul").cast("double"), F.lit(1.0))
    pred = F.col("_l.predicted_RUL")
    health = clip(round_exact(pred / max_rul * F.lit(100.0), 2), 0, 100)
    failure = F.least(round_exact(F.col("unit_anomalies") / F.col("unit_records") * F.lit(100.0)
                                  * F.lit(float(C.FAILURE_RISK_MULTIPLIER)), 2), F.lit(100.0))
    action = F.col("_l.recommended_action")
    return u.select(
        "unit_id", "unit_records", "unit_anomalies",
        F.col("_l.time_cycle").alias("latest_cycle"),
        F.col("_l.RUL").alias("actual_RUL"),
        pred.alias("predicted_RUL"),
        F.abs(F.col("_l.RUL") - pred).alias("abs_error"),
        F.col("_l.anomaly_score").alias("anomaly_score"),
        F.col("_l.anomaly_flag").alias("anomaly_flag"),
        action.alias("recommended_action"),
        truncate_text(action, C.TEXT_TRUNCATE_AT, C.TEXT_TRUNCATE_KEEP).alias("action_display"),
        F.col("_l.risk_score").alias("risk_score"),
        F.col("_l.confidence").alias("confidence"),
        health.alias("health_score"),
        D.health_class(health).alias("health_class"),
        D.alert_level(action).alias("alert_level"),
        D.alert_value(action).alias("alert_value"),
        failure.alias("failure_risk"),
        D.risk_band(F.col("_l.risk_score")).alias("risk_band"))


def recent_anomalies(df: DataFrame, k: int = 10) -> DataFrame:
    """Last ``k`` anomalous cycles of every unit."""
    a = df.where(F.col("anomaly_flag") == -1).select(
        "unit_id", "time_cycle", "risk_score", "confidence", "recommended_action", "justification")
    return top_k_per_unit(a, "unit_id", "time_cycle", k)


def latest_feed(df: DataFrame, n: int = 20, order: str = "event_id") -> DataFrame:
    """Newest ``n`` records (a top-k report), newest first."""
    cols = [order, "unit_id", "time_cycle", "anomaly_flag", "predicted_RUL", "recommended_action", "risk_score",
            "confidence"]
    if "latency_s" in df.columns:
        cols.append(round_exact(F.col("latency_s") * F.lit(1000.0), 2).alias("latency_ms"))
    return df.orderBy(F.col(order).desc()).limit(n).select(*cols)


def live_kpis(df: DataFrame, n: int = C.LIVE_STORE_SIZE, order: str = "event_id") -> DataFrame:
    """KPIs over the live store: the newest ``n`` records."""
    last = df.orderBy(F.col(order).desc()).limit(n)
    return last.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("anomaly_flag") == -1).alias("anomalies"),
        F.count_if(F.col("anomaly_flag") != -1).alias("normals"),
        (F.try_divide(F.count_if(F.col("anomaly_flag") == -1), F.count(F.lit(1))) * 100.0).alias("anomaly_pct"),
        F.avg("predicted_RUL").alias("avg_rul"),
        F.avg("risk_score").alias("avg_risk"))


def error_series(df: DataFrame) -> DataFrame:
    return df.select("unit_id", "time_cycle",
                     F.abs(F.col("RUL") - F.col("predicted_RUL")).alias("abs_error"))


def unit_list(df: DataFrame) -> DataFrame:
    """Units in order."""
    return df.select("unit_id").distinct().orderBy("unit_id")


def axis_max(df: DataFrame, a: str = "RUL", b: str = "predicted_RUL") -> DataFrame:
    return df.agg(F.greatest(F.max(F.col(a).cast("double")), F.max(F.col(b).cast("double"))).alias("axis_max"))


def hash_sample(df: DataFrame, n: int = C.DASHBOARD_SAMPLE_ROWS, seed: int = C.RANDOM_STATE,
                keys=("unit_id", "time_cycle")) -> DataFrame:
    """Exact-size seeded sample of min(n, rows): the n rows with the smallest
    md5 of (keys, seed).  ``orderBy + limit`` plans a top-k (no full sort) and
    the choice does not depend on partitioning."""
    h = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h").limit(n).drop("_h")


def head_rows(df: DataFrame, n: int = C.SAMPLE_STREAM_ROWS, order=("unit_id", "time_cycle")) -> DataFrame:
    return df.orderBy(*order).limit(n)


# --- operational counters -------------------------------------------------------

def counters(scored: DataFrame, rejected: DataFrame) -> DataFrame:
    """requests = scored + rejected, failures = rejected, anomalies among scored."""
    s = scored.agg(F.count(F.lit(1)).alias("ok"),
                   F.count_if(F.col("anomaly_flag") == -1).alias("anomalies"))
    r = rejected.agg(F.count(F.lit(1)).alias("failures"))
    return s.crossJoin(r).select(
        (F.col("ok") + F.col("failures")).alias("requests_total"),
        F.col("failures").alias("failures_total"),
        F.col("anomalies").alias("anomalies_total"))


def success_rates(counts: DataFrame) -> DataFrame:
    n = F.greatest(F.col("requests_total"), F.lit(1)).cast("double")
    return counts.select(
        "requests_total", "failures_total", "anomalies_total",
        (F.lit(100.0) * F.col("anomalies_total") / n).alias("anomaly_pct"),
        (F.lit(100.0) * (F.lit(1.0) - F.col("failures_total") / n)).alias("success_pct"))


def latency_buckets(df: DataFrame, latency: str = "latency_s", bounds=C.LATENCY_BUCKETS) -> DataFrame:
    """Cumulative histogram counts ``le`` per upper bound (+Inf last), one pass."""
    aggs = [F.count_if(F.col(latency) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    aggs.append(F.count(F.col(latency)).alias(f"b{len(bounds)}"))
    one = df.agg(*aggs)
    les = [float(b) for b in bounds] + [float("inf")]
    pairs = ", ".join(f"{i}, CAST('{le}' AS DOUBLE), b{i}" for i, le in enumerate(les))
    return one.selectExpr(f"stack({len(les)}, {pairs}) AS (idx, le, cum)")


def windowed_latency_quantiles(df: DataFrame, **kw) -> DataFrame:
    """Latency quantiles per event-time window: cumulative bucket counts per window
    (one aggregate), then the same interpolation rule inside each window."""
    return window_bucket_quantiles(window_buckets(df, **kw))


def window_buckets(df: DataFrame, ts: str = "ts", width: str = "1 hour", latency: str = "latency_s",
                   bounds=C.LATENCY_BUCKETS) -> DataFrame:
    """window_start and cumulative counts b0, b1, ... (+Inf last); counts of parts add up."""
    aggs = [F.count_if(F.col(latency) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    aggs.append(F.count(F.col(latency)).alias(f"b{len(bounds)}"))
    return df.groupBy(F.window(ts, width).start.alias("window_start")).agg(*aggs)


def window_bucket_quantiles(per: DataFrame, bounds=C.LATENCY_BUCKETS, qs=(0.5, 0.9, 0.99)) -> DataFrame:
    les = [float(b) for b in bounds] + [float("inf")]
    pairs = ", ".join(f"{i}, CAST('{le}' AS DOUBLE), b{i}" for i, le in enumerate(les))
    long = per.selectExpr("window_start", f"stack({len(les)}, {pairs}) AS (idx, le, cum)")
    w = Window.partitionBy("window_start").orderBy("idx")
    b = (long.withColumn("prev_le", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
         .withColumn("prev_cum", F.coalesce(F.lag("cum").over(w), F.lit(0)))
         .withColumn("total", F.max("cum").over(Window.partitionBy("window_start"))))
    q = b.sparkSession.createDataFrame([(float(x),) for x in qs], "quantile double")
    j = b.crossJoin(F.broadcast(q)).withColumn("rank", F.col("quantile") * F.col("total"))
    hit = j.where(F.col("cum") >= F.col("rank"))
    first = Window.partitionBy("window_start", "quantile").orderBy("idx")
    hit = hit.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1)
    val = (F.when(F.col("total") == 0, F.lit(None).cast("double"))
           .when(F.col("le") == float("inf"), F.col("prev_le"))
           .otherwise(F.col("prev_le") + (F.col("le") - F.col("prev_le"))
                      * (F.col("rank") - F.col("prev_cum")) / (F.col("cum") - F.col("prev_cum"))))
    return hit.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "quantile",
                      val.alias("latency_s"))


def histogram_quantiles(buckets: DataFrame, qs=(0.5, 0.9, 0.99)) -> DataFrame:
    """Linear interpolation inside the bucket that holds rank q * total
    (histogram_quantile rule: first bucket starts at 0; a rank in the +Inf
    bucket returns the largest finite bound)."""
    w = Window.orderBy("idx")  # at most len(bounds)+1 rows
    b = (buckets.withColumn("prev_le", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
         .withColumn("prev_cum", F.coalesce(F.lag("cum").over(w), F.lit(0)))
         .withColumn("total", F.max("cum").over(Window.partitionBy())))
    q = b.sparkSession.createDataFrame([(float(x),) for x in qs], "quantile double")
    j = b.crossJoin(F.broadcast(q)).withColumn("rank", F.col("quantile") * F.col("total"))
    hit = j.where(F.col("cum") >= F.col("rank"))
    first = Window.partitionBy("quantile").orderBy("idx")
    hit = hit.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1)
    val = (F.when(F.col("total") == 0, F.lit(None).cast("double"))
           .when(F.col("le") == float("inf"), F.col("prev_le"))
           .otherwise(F.col("prev_le") + (F.col("le") - F.col("prev_le"))
                      * (F.col("rank") - F.col("prev_cum")) / (F.col("cum") - F.col("prev_cum"))))
    return hit.select("quantile", val.alias("latency_s"))


def unit_replay(df: DataFrame, unit=None) -> DataFrame:
    """One unit's records in cycle order (the dashboard's selected unit; default:
    the first unit of the sorted unit list)."""
    if unit is None:
        first = df.agg(F.min("unit_id").alias("_u"))
        sel = df.join(F.broadcast(first), F.col("unit_id") == F.col("_u"), "left_semi")
    else:
        sel = df.where(F.col("unit_id") == unit)
    return (sel.select("unit_id", "time_cycle", "sensor_2", "anomaly_flag", "recommended_action")
            .orderBy("time_cycle"))


def live_records(df: DataFrame, limit: int = 200, order: str = "event_id") -> DataFrame:
    """The live store read: the newest min(limit, 500) records, with their sequence
    number 1..n in arrival order (numbered after the limit, at most 500 rows)."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    k = min(limit, C.LIVE_STORE_SIZE)
    last = df.orderBy(F.col(order).desc()).limit(k)
    seq = F.row_number().over(Window.orderBy(order)).cast("long")
    extra = [F.date_format("ts", "HH:mm:ss").alias("time_hms")] if "ts" in df.columns else []
    return last.select(seq.alias("seq"), order, "unit_id", "time_cycle", "anomaly_flag", "predicted_RUL",
                       "recommended_action", "risk_score", "confidence", *extra)
