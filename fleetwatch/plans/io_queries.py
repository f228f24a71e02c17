"""Source / sink round trips over the given tables (written to the shared
checkpoint folder, read back, compared with the SQL of the table written)."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import round_exact
from ..operators import evaluate as E
from ..operators import sketches as K
from ..operators.features import add_rul, add_telemetry_features
from ..session import materialize
from ..sources import files as FS
from ..sources import tables as T
from ..streaming.pipeline import scratch
from .catalog import DEC, W, decided, query, rx

WIDE_SENSORS = ["sensor_2", "sensor_3", "sensor_4", "sensor_11", "sensor_15", "sensor_21"]


def _padded_wide(spark, sf):
    w = T.telemetry_wide(spark, sf)
    cols = {c: F.lit(0.0) for c in C.SENSOR_COLUMNS if c not in w.columns}
    return w.withColumns(cols).select(*C.RAW_COLUMNS)


@query("raw_text_scan", W("SELECT unit_id, time_cycle, op_setting_1, op_setting_2, op_setting_3, "
                          + ", ".join(WIDE_SENSORS) + ", CAST(0 AS DOUBLE) AS sensor_1 FROM telemetry_wide",
                          "telemetry_wide"))
def raw_text_scan(spark, sf):
    """Whitespace text scan: the wide telemetry written as 26 blank-separated
    columns (trailing blank), plus a short, an overlong and a non-numeric line that
    must land in the rejects."""
    path = scratch(spark, "raw-text")
    FS.write_whitespace_table(_padded_wide(spark, sf), f"{path}/part=rows")
    bad = spark.createDataFrame([("1 2 3",), (" ".join(["7"] * 27),), ("1 2 x " + " ".join(["0.5"] * 23),)], "value string")
    bad.write.mode("overwrite").text(f"{path}/part=bad")
    rows, rejects = FS.load_whitespace_table(spark, f"{path}/part=*")
    if rejects.count() != 3:
        raise AssertionError("reject path broken")
    return rows.select("unit_id", "time_cycle", "op_setting_1", "op_setting_2", "op_setting_3", *WIDE_SENSORS,
                       "sensor_1")


@query("results_csv_roundtrip", W("SELECT unit_id, time_cycle, RUL, anomaly_score, anomaly_flag, predicted_RUL, "
                                  "recommended_action, risk_score, confidence, justification FROM decided", DEC))
def results_csv_roundtrip(spark, sf):
    """Results table -> CSV with header -> preferred-source load with a fixed schema."""
    cols = ["unit_id", "time_cycle", "RUL", "anomaly_score", "anomaly_flag", "predicted_RUL", "recommended_action",
            "risk_score", "confidence", "justification"]
    d = decided(spark, sf).select(*cols)
    base = scratch(spark, "results-csv")
    FS.write_results_csv(d, base)
    return FS.load_preferred(spark, [base + "-extended", base], d.schema)


@query("metric_text_roundtrip", W(
    "SELECT metric, value FROM (SELECT 'MAE' AS metric, " + rx("avg(abs(predicted_RUL - RUL))", 4) + " AS value FROM scored "
    "UNION ALL SELECT 'MSE', " + rx("avg((predicted_RUL - RUL) * (predicted_RUL - RUL))", 4) + " FROM scored "
    "UNION ALL SELECT 'RMSE', " + rx("sqrt(avg((predicted_RUL - RUL) * (predicted_RUL - RUL)))", 4) + " FROM scored "
    "UNION ALL SELECT 'R2', " + rx("1 - sum((predicted_RUL - RUL) * (predicted_RUL - RUL)) / "
                                   "(var_pop(CAST(RUL AS DOUBLE)) * count(*))", 4) + " FROM scored) m", "scored"))
def metric_text_roundtrip(spark, sf):
    """Metric text sink (``k: v`` with four decimals) read back by the metric-text scan."""
    m = E.regression_metrics(T.scored(spark, sf))
    path = scratch(spark, "metrics-text")
    FS.write_metric_text(E.metrics_long(m, "RF"), path, "RUL Model Evaluation on Test Data")
    return FS.read_metric_text(spark, path, "RUL")


@query("bucketed_features", W("SELECT unit_id, time_cycle, sensor_2, max(time_cycle) OVER (PARTITION BY unit_id) - time_cycle AS RUL, "
                              "avg(sensor_2) OVER w AS sensor_2_rolling_mean, "
                              "coalesce(sensor_2 - lag(sensor_2) OVER (PARTITION BY unit_id ORDER BY time_cycle), CAST(0 AS DOUBLE)) AS sensor_2_diff "
                              "FROM telemetry WINDOW w AS (PARTITION BY unit_id ORDER BY time_cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
                              "telemetry"))
def bucketed_features(spark, sf):
    """Telemetry stored by unit; labels and features from it without an exchange."""
    stored = FS.write_bucketed(T.telemetry(spark, sf), scratch(spark, "bucketed"), buckets=16)
    return add_telemetry_features(add_rul(stored)).select("unit_id", "time_cycle", "sensor_2", "RUL", "sensor_2_rolling_mean", "sensor_2_diff")


SKETCHED = [0.05, 0.5, 0.9, 0.95, 0.99]


@query("latency_sketches", W("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, q.quantile, count(latency_s) AS n, TRUE AS within_bound "
                             "FROM scored CROSS JOIN (VALUES " + ", ".join(f"(CAST({q} AS DOUBLE))" for q in SKETCHED) + ") q(quantile) "
                             "GROUP BY 1, 2 UNION ALL SELECT 'all', q.quantile, count(latency_s), TRUE FROM scored CROSS JOIN (VALUES "
                             + ", ".join(f"(CAST({q} AS DOUBLE))" for q in SKETCHED) + ") q(quantile) GROUP BY 2", "scored"))
def latency_sketches(spark, sf):
    """Stored sketches per day and unit group, merged to days and to the whole, and whether
    the rank of each estimate is within the stated error (over all rows)."""
    rows = T.scored(spark, sf).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.pmod("unit_id", F.lit(8)).alias("unit_group"), "latency_s")
    rows = materialize(rows, "latencies")
    stored = materialize(K.sketches(rows, "latency_s", ["day", "unit_group"]), "latency-sketches")
    by_day = K.rank_errors(rows, "latency_s", K.quantiles(K.merged(stored, ["day"]).drop("n"), SKETCHED), ["day"])
    whole = K.rank_errors(rows, "latency_s", K.quantiles(K.merged(stored, []).drop("n"), SKETCHED), []).select(F.lit("all").alias("day"), "*")
    return by_day.unionByName(whole).select("day", "quantile", "n", (F.col("rank_error") <= K.RANK_ERROR).alias("within_bound"))
