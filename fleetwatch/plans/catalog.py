"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` and their SQL oracle.

Every query reads the given tables in full (no id subsets or row caps); limits
appear only where the limit is the feature (top-k feeds, fixed-size samples).
Floating aggregates whose summation order differs between engines are rounded
to 6-9 places on both sides with the same exact rule.
"""
from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import decisions as D
from ..functions.numeric import round_exact, round_exact_sql
from ..operators import evaluate as E
from ..operators import policy as P
from ..operators import reports as R
from ..operators.features import add_rul, add_telemetry_features, ground_truth, scale_features, sequence_summaries
from ..session import keep_compiled
from ..sources import tables as T
from . import oracle as O

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            keep_compiled(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


def decided(spark: SparkSession, sf: str) -> DataFrame:
    return D.with_decision(T.scored(spark, sf))


W = O.with_views
rx = round_exact_sql
DEC = "decided"

# --------------------------------------------------------------- labels, features

query("rul_label", W("SELECT unit_id, time_cycle, event_id, sensor_2, "
                     "max(time_cycle) OVER (PARTITION BY unit_id) - time_cycle AS RUL FROM telemetry", "telemetry"))(
    lambda spark, sf: add_rul(T.telemetry(spark, sf)).select("unit_id", "time_cycle", "event_id", "sensor_2", "RUL"))


def _feature_sql(sensors, src: str, extra: str = "") -> str:
    cols = []
    for s in sensors:
        cols.append(f"avg({s}) OVER (PARTITION BY unit_id ORDER BY time_cycle ROWS BETWEEN "
                    f"4 PRECEDING AND CURRENT ROW) AS {s}_rolling_mean")
        cols.append(f"coalesce({s} - lag({s}) OVER (PARTITION BY unit_id ORDER BY time_cycle), "
                    f"CAST(0 AS DOUBLE)) AS {s}_diff")
    return f"SELECT *{extra}, {', '.join(cols)} FROM {src}"


query("rolling_features", W(f"SELECT unit_id, time_cycle, sensor_2, sensor_2_rolling_mean, sensor_2_diff FROM "
                            f"({_feature_sql(['sensor_2'], 'telemetry')}) f", "telemetry"))(
    lambda spark, sf: add_telemetry_features(T.telemetry(spark, sf)).select(
        "unit_id", "time_cycle", "sensor_2", "sensor_2_rolling_mean", "sensor_2_diff"))

query("wide_features", W(_feature_sql(C.SELECTED_SENSORS, "telemetry_wide"), "telemetry_wide"))(
    lambda spark, sf: add_telemetry_features(T.telemetry_wide(spark, sf)))

def _with_holes(df: DataFrame) -> DataFrame:
    """Telemetry whose cycles have gaps, short and long."""
    return df.where((F.col("time_cycle") % 7 != 3) & ~F.col("time_cycle").between(14, 31))


HOLES = "time_cycle % 7 <> 3 AND NOT time_cycle BETWEEN 14 AND 31"
query("rolling_features_gaps", W("SELECT unit_id, time_cycle, sensor_2, sensor_2_rolling_mean, sensor_2_diff FROM "
                                 f"({_feature_sql(['sensor_2'], f'(SELECT * FROM telemetry WHERE {HOLES}) t')}) f", "telemetry"))(
    lambda spark, sf: add_telemetry_features(_with_holes(T.telemetry(spark, sf))).select(
        "unit_id", "time_cycle", "sensor_2", "sensor_2_rolling_mean", "sensor_2_diff"))


WIDE_LABELED_SQL = ("(" + _feature_sql(C.SELECTED_SENSORS,
                                       "(SELECT *, max(time_cycle) OVER (PARTITION BY unit_id) - time_cycle AS RUL "
                                       "FROM telemetry_wide) l") + ")")
WIDE_FEATURES = (["op_setting_1", "op_setting_2", "op_setting_3"] + C.SELECTED_SENSORS
                 + [f"{s}_{k}" for s in C.SELECTED_SENSORS for k in ("rolling_mean", "diff")])


def _stats_sql() -> str:
    return ", ".join(f"avg({c}) AS {c}__mean, stddev_pop({c}) AS {c}__std" for c in WIDE_FEATURES)


@query("zscore_scale", W(
    f"SELECT unit_id, time_cycle, RUL, "
    + ", ".join(rx(f"({c} - {c}__mean) / (CASE WHEN {c}__std = 0 THEN CAST(1 AS DOUBLE) ELSE {c}__std END)", 6)
                + f" AS {c}" for c in WIDE_FEATURES)
    + f" FROM {WIDE_LABELED_SQL} f CROSS JOIN (SELECT {_stats_sql()} FROM {WIDE_LABELED_SQL} g) s",
    "telemetry_wide"))
def zscore_scale(spark, sf):
    df = T.wide_labeled(spark, sf, materialize=True)
    scaled, _, cols = scale_features(df, WIDE_FEATURES)
    staged = scaled.select("unit_id", "time_cycle", "RUL", *cols)
    return staged.select("unit_id", "time_cycle", "RUL", *[round_exact(c, 6).alias(c) for c in cols])


@query("scaler_stats", W("SELECT " + ", ".join(f"{rx(f'avg({c})', 5)} AS {c}__mean, {rx(f'stddev_pop({c})', 5)} AS {c}__std"
                                               for c in WIDE_FEATURES) + f" FROM {WIDE_LABELED_SQL} f", "telemetry_wide"))
def scaler_stats(spark, sf):
    from ..operators.features import scaler_stats as stats
    s = stats(T.wide_labeled(spark, sf), WIDE_FEATURES)
    return s.select(*[round_exact(c, 5).alias(c) for c in s.columns])


# --------------------------------------------------------------- decisions

for _name, _col in [("action_rules", "recommended_action"), ("risk_score", "risk_score"),
                    ("confidence_level", "confidence"), ("justification", "justification")]:
    query(_name, W(f"SELECT unit_id, time_cycle, anomaly_flag, anomaly_score, predicted_RUL, {_col} FROM decided", DEC))(
        (lambda c: lambda spark, sf: decided(spark, sf).select(
            "unit_id", "time_cycle", "anomaly_flag", "anomaly_score", "predicted_RUL", c))(_col))

_BLANKED = ("(SELECT unit_id, time_cycle, event_id, anomaly_flag, CASE WHEN event_id % 7 = 0 THEN NULL ELSE anomaly_score END "
            "AS anomaly_score, CASE WHEN event_id % 5 = 0 THEN NULL ELSE predicted_RUL END AS predicted_RUL FROM scored)")
_BLANK_COLS = (f"{O.action_sql()} AS recommended_action, CASE WHEN anomaly_score IS NULL AND anomaly_flag = -1 OR predicted_RUL IS NULL THEN NULL "
               f"ELSE {rx(O.raw_risk_sql(), 4)} END AS risk_score, {O.confidence_sql()} AS confidence, {O.justification_sql()} AS justification")


@query("decisions_with_nulls", W(f"SELECT unit_id, time_cycle, {_BLANK_COLS} FROM {_BLANKED} b", "scored"))
def decisions_with_nulls(spark, sf):
    """Some scores are NULL and some remaining lives NaN: both count as unknown."""
    s = T.scored(spark, sf)
    s = s.withColumns({"anomaly_score": F.when(F.col("event_id") % 7 != 0, F.col("anomaly_score")),
                       "predicted_RUL": F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("predicted_RUL"))})
    return D.with_decision(s).select("unit_id", "time_cycle", "recommended_action", "risk_score", "confidence", "justification")


query("decision_enriched", W("SELECT unit_id, time_cycle, recommended_action, risk_score, confidence, justification "
                             "FROM decided", DEC))(
    lambda spark, sf: decided(spark, sf).select("unit_id", "time_cycle", "recommended_action", "risk_score",
                                                "confidence", "justification"))

_HEALTH = rx("d.predicted_RUL / greatest(CAST(u.max_rul AS DOUBLE), CAST(1 AS DOUBLE)) * CAST(100 AS DOUBLE)", 2)
_HEALTH = O.clip_sql(_HEALTH, 0, 100)
_FAIL = (f"least({rx('u.unit_anomalies / u.unit_records * CAST(100 AS DOUBLE) * CAST(5 AS DOUBLE)', 2)}, "
         f"CAST(100 AS DOUBLE))")
UNIT_STATUS_SQL = W(
    "SELECT u.unit_id, u.unit_records, u.unit_anomalies, u.latest_cycle, d.RUL AS actual_RUL, d.predicted_RUL, "
    "abs(d.RUL - d.predicted_RUL) AS abs_error, d.anomaly_score, d.anomaly_flag, d.recommended_action, "
    "CASE WHEN length(d.recommended_action) > 30 THEN substr(d.recommended_action, 1, 28) || '…' "
    "ELSE d.recommended_action END AS action_display, d.risk_score, "
    f"d.confidence, {_HEALTH} AS health_score, {O.health_class_sql(_HEALTH)} AS health_class, "
    f"{O.alert_level_sql('d.recommended_action')} AS alert_level, {O.alert_value_sql('d.recommended_action')} AS alert_value, "
    f"{_FAIL} AS failure_risk, {O.risk_band_sql('d.risk_score')} AS risk_band "
    "FROM (SELECT unit_id, count(*) AS unit_records, count(*) FILTER (WHERE anomaly_flag = -1) AS unit_anomalies, "
    "max(RUL) AS max_rul, max(time_cycle) AS latest_cycle FROM decided GROUP BY unit_id) u "
    "JOIN decided d ON d.unit_id = u.unit_id AND d.time_cycle = u.latest_cycle", DEC)


def unit_status(spark, sf):
    return R.unit_status(decided(spark, sf))


query("unit_status", UNIT_STATUS_SQL)(unit_status)
query("unit_health", f"SELECT unit_id, health_score, health_class FROM ({UNIT_STATUS_SQL}) s")(
    lambda spark, sf: unit_status(spark, sf).select("unit_id", "health_score", "health_class"))
query("failure_risk", f"SELECT unit_id, unit_records, unit_anomalies, failure_risk FROM ({UNIT_STATUS_SQL}) s")(
    lambda spark, sf: unit_status(spark, sf).select("unit_id", "unit_records", "unit_anomalies", "failure_risk"))
query("alert_level", f"SELECT unit_id, recommended_action, alert_level, alert_value FROM ({UNIT_STATUS_SQL}) s")(
    lambda spark, sf: unit_status(spark, sf).select("unit_id", "recommended_action", "alert_level", "alert_value"))

# --------------------------------------------------------------- fleet dashboards

query("fleet_kpis", W("SELECT count(*) AS total_records, count(*) FILTER (WHERE anomaly_flag = -1) AS detected_anomalies, "
                      "count(*) FILTER (WHERE anomaly_flag = 1) AS normal_records, "
                      "count(*) FILTER (WHERE coalesce(contains(recommended_action, 'CRITICAL'), false)) AS critical_cases "
                      "FROM decided", DEC))(lambda spark, sf: R.fleet_kpis(decided(spark, sf)))


def _vc_sql(expr: str) -> str:
    return W(f"SELECT value, count(*) AS n FROM (SELECT {expr} AS value FROM decided) v "
             f"WHERE value IS NOT NULL GROUP BY value", DEC)


query("action_counts", _vc_sql("recommended_action"))(
    lambda spark, sf: R.value_counts(decided(spark, sf), "recommended_action"))
query("flag_counts", _vc_sql("CASE WHEN anomaly_flag = 1 THEN 'Normal' WHEN anomaly_flag = -1 THEN 'Anomaly' END"))(
    lambda spark, sf: R.value_counts(decided(spark, sf), D.flag_label("anomaly_flag")))
query("ae_flag_counts", _vc_sql("CASE WHEN autoencoder_anomaly_flag = 0 THEN 'Normal' "
                                "WHEN autoencoder_anomaly_flag = 1 THEN 'Anomaly' END"))(
    lambda spark, sf: R.value_counts(decided(spark, sf), D.ae_flag_label("autoencoder_anomaly_flag")))
query("confidence_counts", _vc_sql("confidence"))(
    lambda spark, sf: R.value_counts(decided(spark, sf), "confidence"))
query("model_agreement", _vc_sql(O.agreement_sql()))(
    lambda spark, sf: R.value_counts(decided(spark, sf), D.agreement("anomaly_flag", "autoencoder_anomaly_flag")))
query("risk_bands", _vc_sql(O.risk_band_sql()))(
    lambda spark, sf: R.value_counts(decided(spark, sf), D.risk_band("risk_score")))
query("risk_histogram", W("SELECT bin, count(*) AS n, bin / CAST(30 AS DOUBLE) AS bin_low, "
                          "(bin + 1) / CAST(30 AS DOUBLE) AS bin_high FROM (SELECT CAST(least(floor(risk_score * 30), 29) "
                          "AS BIGINT) AS bin FROM decided WHERE risk_score IS NOT NULL) b GROUP BY bin", DEC))(
    lambda spark, sf: R.risk_histogram(decided(spark, sf)))


def _unit_vc(name: str, sql_value: str, value):
    """The counts of the dashboard's unit pages, for every unit."""
    sql = W(f"SELECT unit_id, value, count(*) AS n FROM (SELECT unit_id, {sql_value} AS value FROM decided) v WHERE value IS NOT NULL "
            "GROUP BY unit_id, value", DEC)
    query(name, sql)(lambda spark, sf: R.value_counts(decided(spark, sf), value(), by=("unit_id",)))


_unit_vc("unit_action_counts", "recommended_action", lambda: F.col("recommended_action"))
_unit_vc("unit_flag_counts", "CASE WHEN anomaly_flag = 1 THEN 'Normal' WHEN anomaly_flag = -1 THEN 'Anomaly' END",
         lambda: D.flag_label("anomaly_flag"))
_unit_vc("unit_ae_flag_counts", "CASE WHEN autoencoder_anomaly_flag = 0 THEN 'Normal' WHEN autoencoder_anomaly_flag = 1 THEN 'Anomaly' END",
         lambda: D.ae_flag_label("autoencoder_anomaly_flag"))
_unit_vc("unit_confidence_counts", "confidence", lambda: F.col("confidence"))
_unit_vc("unit_model_agreement", O.agreement_sql(), lambda: D.agreement("anomaly_flag", "autoencoder_anomaly_flag"))
query("unit_risk_histogram", W("SELECT unit_id, bin, count(*) AS n, bin / CAST(30 AS DOUBLE) AS bin_low, "
                               "(bin + 1) / CAST(30 AS DOUBLE) AS bin_high FROM (SELECT unit_id, CAST(least(floor(risk_score * 30), 29) "
                               "AS BIGINT) AS bin FROM decided WHERE risk_score IS NOT NULL) b GROUP BY unit_id, bin", DEC))(
    lambda spark, sf: R.risk_histogram(decided(spark, sf), by=("unit_id",)))

query("recent_anomalies", W("SELECT * FROM (SELECT unit_id, time_cycle, risk_score, confidence, recommended_action, "
                            "justification, row_number() OVER (PARTITION BY unit_id ORDER BY time_cycle DESC) "
                            "AS rank_from_latest FROM decided WHERE anomaly_flag = -1) a WHERE rank_from_latest <= 10", DEC))(
    lambda spark, sf: R.recent_anomalies(decided(spark, sf)))
query("latest_feed", W("SELECT event_id, unit_id, time_cycle, anomaly_flag, predicted_RUL, recommended_action, "
                       f"risk_score, confidence, {rx('latency_s * CAST(1000 AS DOUBLE)', 2)} AS latency_ms "
                       "FROM decided ORDER BY event_id DESC LIMIT 20", DEC))(
    lambda spark, sf: R.latest_feed(decided(spark, sf)))


@query("live_kpis", W(
    "SELECT count(*) AS total, count(*) FILTER (WHERE anomaly_flag = -1) AS anomalies, "
    "count(*) FILTER (WHERE anomaly_flag <> -1) AS normals, "
    "count(*) FILTER (WHERE anomaly_flag = -1) / count(*) * CAST(100 AS DOUBLE) AS anomaly_pct, "
    f"{rx('avg(predicted_RUL)', 9)} AS avg_rul, {rx('avg(risk_score)', 9)} AS avg_risk "
    "FROM (SELECT * FROM decided ORDER BY event_id DESC LIMIT 500) l", DEC))
def live_kpis(spark, sf):
    k = R.live_kpis(decided(spark, sf))
    return k.withColumns({"avg_rul": round_exact("avg_rul", 9), "avg_risk": round_exact("avg_risk", 9)})


query("error_series", W("SELECT unit_id, time_cycle, abs(RUL - predicted_RUL) AS abs_error FROM scored", "scored"))(
    lambda spark, sf: R.error_series(T.scored(spark, sf)))
query("unit_list", W("SELECT DISTINCT unit_id FROM telemetry", "telemetry"))(
    lambda spark, sf: R.unit_list(T.telemetry(spark, sf)))
query("axis_max", W("SELECT greatest(max(CAST(RUL AS DOUBLE)), max(predicted_RUL)) AS axis_max FROM scored", "scored"))(
    lambda spark, sf: R.axis_max(T.scored(spark, sf)))
query("dashboard_sample", W("SELECT unit_id, time_cycle, RUL, predicted_RUL FROM scored ORDER BY "
                            "md5(concat_ws(':', CAST(unit_id AS VARCHAR), CAST(time_cycle AS VARCHAR), '42')) LIMIT 5000",
                            "scored"))(
    lambda spark, sf: R.hash_sample(T.scored(spark, sf)).select("unit_id", "time_cycle", "RUL", "predicted_RUL"))
query("sample_axis_max", W("SELECT greatest(max(CAST(RUL AS DOUBLE)), max(predicted_RUL)) AS axis_max FROM (SELECT RUL, predicted_RUL "
                           "FROM scored ORDER BY md5(concat_ws(':', CAST(unit_id AS VARCHAR), CAST(time_cycle AS VARCHAR), '42')) "
                           "LIMIT 5000) s", "scored"))(
    lambda spark, sf: R.axis_max(R.hash_sample(T.scored(spark, sf))))
query("sample_stream", W("SELECT unit_id, time_cycle, sensor_2, RUL, anomaly_flag, recommended_action FROM decided "
                         "ORDER BY unit_id, time_cycle LIMIT 200", DEC))(
    lambda spark, sf: R.head_rows(decided(spark, sf)).select("unit_id", "time_cycle", "sensor_2", "RUL", "anomaly_flag",
                                                            "recommended_action"))
query("flag_labels", W("SELECT unit_id, time_cycle, CASE WHEN anomaly_flag = 1 THEN 'Normal' WHEN anomaly_flag = -1 "
                       "THEN 'Anomaly' END AS if_label, CASE WHEN autoencoder_anomaly_flag = 0 THEN 'Normal' "
                       "WHEN autoencoder_anomaly_flag = 1 THEN 'Anomaly' END AS ae_label, "
                       "CASE WHEN anomaly_flag = -1 THEN 1 ELSE 0 END AS if_indicator FROM scored", "scored"))(
    lambda spark, sf: T.scored(spark, sf).select(
        "unit_id", "time_cycle", D.flag_label("anomaly_flag").alias("if_label"),
        D.ae_flag_label("autoencoder_anomaly_flag").alias("ae_label"),
        D.anomaly_indicator("anomaly_flag").alias("if_indicator")))
query("anomaly_rows", W("SELECT unit_id, time_cycle, anomaly_score, reconstruction_error FROM scored "
                        "WHERE anomaly_flag = -1 OR autoencoder_anomaly_flag = 1", "scored"))(
    lambda spark, sf: T.scored(spark, sf).where((F.col("anomaly_flag") == -1) | (F.col("autoencoder_anomaly_flag") == 1))
    .select("unit_id", "time_cycle", "anomaly_score", "reconstruction_error"))
query("healthy_rows", W("SELECT unit_id, time_cycle, sensor_2, RUL FROM scored WHERE RUL > 50", "scored"))(
    lambda spark, sf: T.scored(spark, sf).where(F.col("RUL") > C.AUTOENCODER_RUL_THRESHOLD)
    .select("unit_id", "time_cycle", "sensor_2", "RUL"))

# --------------------------------------------------------------- evaluation

_TRUTH = "CAST(RUL <= 15 AS INTEGER)"


def _cm_sql(pred: str) -> str:
    return W("SELECT a.actual, p.predicted, coalesce(c.n, 0) AS n FROM (VALUES (0), (1)) a(actual) "
             "CROSS JOIN (VALUES (0), (1)) p(predicted) LEFT JOIN (SELECT "
             f"{_TRUTH} AS actual, {pred} AS predicted, count(*) AS n FROM scored GROUP BY 1, 2) c "
             "ON c.actual = a.actual AND c.predicted = p.predicted", "scored")


IF_PRED = "CASE WHEN anomaly_flag = -1 THEN 1 ELSE 0 END"
AE_PRED = "autoencoder_anomaly_flag"


def _truth_pred(spark, sf, ae: bool) -> DataFrame:
    s = ground_truth(T.scored(spark, sf))
    pred = F.col("autoencoder_anomaly_flag") if ae else D.anomaly_indicator("anomaly_flag")
    return s.withColumn("pred_anomaly", pred)


query("confusion_matrix", _cm_sql(IF_PRED))(
    lambda spark, sf: E.confusion_matrix(_truth_pred(spark, sf, False)))
query("ae_confusion_matrix", _cm_sql(AE_PRED))(
    lambda spark, sf: E.confusion_matrix(_truth_pred(spark, sf, True)))


def _report_sql(pred: str) -> str:
    cm = _cm_sql(pred)
    c = {f"{a}{p}": f"CAST(sum(CASE WHEN actual = {a} AND predicted = {p} THEN n ELSE 0 END) AS DOUBLE)"
         for a in (0, 1) for p in (0, 1)}

    def div(a, b):
        return f"(CASE WHEN ({b}) = 0 THEN CAST(0 AS DOUBLE) ELSE ({a}) / ({b}) END)"

    rows = {}
    for k in (0, 1):
        tp, fp, fn = f"c{k}{k}", f"c{1 - k}{k}", f"c{k}{1 - k}"
        p = div(tp, f"{tp} + {fp}")
        r = div(tp, f"{tp} + {fn}")
        rows[k] = (p, r, div(f"2 * {p} * {r}", f"{p} + {r}"), f"({tp} + {fn})")
    total = "(c00 + c01 + c10 + c11)"
    s0, s1 = rows[0][3], rows[1][3]
    sel = []
    for k in (0, 1):
        p, r, f1, s = rows[k]
        sel.append(f"SELECT '{k}' AS label, {p} AS precision, {r} AS recall, {f1} AS f1_score, {s} AS support FROM c")
    sel.append(f"SELECT 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), {div('c00 + c11', total)}, {total} FROM c")
    sel.append("SELECT 'macro avg', " + ", ".join(f"({rows[0][i]} + {rows[1][i]}) / 2" for i in (0, 1, 2))
               + f", {total} FROM c")
    sel.append("SELECT 'weighted avg', " + ", ".join(div(f"{rows[0][i]} * {s0} + {rows[1][i]} * {s1}", total)
                                                     for i in (0, 1, 2)) + f", {total} FROM c")
    body = " UNION ALL ".join(sel)
    cte = "SELECT " + ", ".join(f"{v} AS c{k}" for k, v in c.items()) + f" FROM ({cm}) m"
    return (f"WITH c AS ({cte}) SELECT label, {rx('precision', 4)} AS precision, {rx('recall', 4)} AS recall, "
            f"{rx('f1_score', 4)} AS f1_score, CAST(support AS BIGINT) AS support FROM ({body}) r")


query("classification_report", _report_sql(IF_PRED))(
    lambda spark, sf: E.classification_report(E.confusion_matrix(_truth_pred(spark, sf, False))))
query("ae_classification_report", _report_sql(AE_PRED))(
    lambda spark, sf: E.classification_report(E.confusion_matrix(_truth_pred(spark, sf, True))))

_CUM = ("(SELECT *, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp, "
        "sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N "
        f"FROM (SELECT reconstruction_error AS s, sum({_TRUTH}) AS pos, sum(1 - {_TRUTH}) AS neg FROM scored "
        "WHERE reconstruction_error IS NOT NULL GROUP BY 1) g) c")
query("roc_auc", W(f"SELECT {rx('sum(neg / N * (2 * tp - pos) / (2 * P))', 9)} AS roc_auc FROM {_CUM}", "scored"))(
    lambda spark, sf: E.roc_auc(ground_truth(T.scored(spark, sf))).select(round_exact("roc_auc", 9).alias("roc_auc")))
query("average_precision", W(f"SELECT {rx('sum(pos / P * (tp / (tp + fp)))', 9)} AS average_precision FROM {_CUM}",
                             "scored"))(
    lambda spark, sf: E.average_precision(ground_truth(T.scored(spark, sf))).select(
        round_exact("average_precision", 9).alias("average_precision")))

query("regression_metrics", W(
    f"SELECT count(*) AS n, {rx('avg(abs(predicted_RUL - RUL))', 6)} AS MAE, "
    f"{rx('avg((predicted_RUL - RUL) * (predicted_RUL - RUL))', 6)} AS MSE, "
    f"{rx('sqrt(avg((predicted_RUL - RUL) * (predicted_RUL - RUL)))', 6)} AS RMSE, "
    f"{rx('1 - sum((predicted_RUL - RUL) * (predicted_RUL - RUL)) / (var_pop(CAST(RUL AS DOUBLE)) * count(*))', 6)} AS R2 "
    "FROM scored", "scored"))(
    lambda spark, sf: E.regression_metrics(T.scored(spark, sf)).select(
        "n", *[round_exact(c, 6).alias(c) for c in ("MAE", "MSE", "RMSE", "R2")]))


@query("model_comparison", W(
    "SELECT m.metric, r.value AS RF, CAST(NULL AS DOUBLE) AS LSTM FROM (VALUES ('MAE'), ('RMSE'), ('R2')) m(metric) "
    "LEFT JOIN (SELECT 'MAE' AS metric, " + rx('avg(abs(predicted_RUL - RUL))', 6) + " AS value FROM scored UNION ALL "
    "SELECT 'RMSE', " + rx('sqrt(avg((predicted_RUL - RUL) * (predicted_RUL - RUL)))', 6) + " FROM scored UNION ALL "
    "SELECT 'R2', " + rx('1 - sum((predicted_RUL - RUL) * (predicted_RUL - RUL)) / (var_pop(CAST(RUL AS DOUBLE)) * count(*))', 6)
    + " FROM scored) r ON r.metric = m.metric", "scored"))
def model_comparison(spark, sf):
    m = E.regression_metrics(T.scored(spark, sf))
    m = m.select(*[round_exact(c, 6).alias(c) for c in ("MAE", "MSE", "RMSE", "R2")])
    return E.model_comparison(E.metrics_long(m, "RF"))


query("healthy_threshold_p95", W(f"SELECT {rx('quantile_cont(reconstruction_error, 0.95)', 9)} AS threshold "
                                 "FROM scored WHERE RUL > 50", "scored"))(
    lambda spark, sf: E.percentile_threshold(T.scored(spark, sf).where(F.col("RUL") > C.AUTOENCODER_RUL_THRESHOLD),
                                             "reconstruction_error", C.AUTOENCODER_PERCENTILE)
    .select(round_exact("threshold", 9).alias("threshold")))
query("contamination_offset", W(f"SELECT {rx('quantile_cont(anomaly_score, 0.05)', 9)} AS threshold FROM scored",
                                "scored"))(
    lambda spark, sf: E.percentile_threshold(T.scored(spark, sf), "anomaly_score", C.ANOMALY_CONTAMINATION)
    .select(round_exact("threshold", 9).alias("threshold")))

# --------------------------------------------------------------- sequences, splits

_SEQ = ("SELECT unit_id, time_cycle AS end_cycle, min(time_cycle) OVER f AS seq_start, count(*) OVER f AS seq_len, RUL, "
        "first_value(sensor_2) OVER f AS sensor_2__first, sensor_2 AS sensor_2__last, "
        f"{rx('avg(sensor_2) OVER f', 9)} AS sensor_2__mean, min(sensor_2) OVER f AS sensor_2__min, "
        "max(sensor_2) OVER f AS sensor_2__max FROM (SELECT *, max(time_cycle) OVER (PARTITION BY unit_id) - time_cycle "
        "AS RUL FROM telemetry_ragged) r WINDOW f AS (PARTITION BY unit_id ORDER BY time_cycle "
        f"ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
query("sequence_windows", W(f"SELECT *, (sensor_2__last - sensor_2__first) / CAST(29 AS DOUBLE) "
                            f"AS sensor_2__slope FROM ({_SEQ}) w WHERE seq_len = 30", "telemetry_ragged"))(
    lambda spark, sf: sequence_summaries(add_rul(T.telemetry_ragged(spark, sf)), ["sensor_2"])
    .withColumn("sensor_2__mean", round_exact("sensor_2__mean", 9)))

_SEQ_FULL = _SEQ.replace("telemetry_ragged", "telemetry")
query("sequence_windows_full", W(f"SELECT *, (sensor_2__last - sensor_2__first) / CAST(29 AS DOUBLE) "
                                 f"AS sensor_2__slope FROM ({_SEQ_FULL}) w WHERE seq_len = 30", "telemetry"))(
    lambda spark, sf: sequence_summaries(add_rul(T.telemetry(spark, sf)), ["sensor_2"])
    .withColumn("sensor_2__mean", round_exact("sensor_2__mean", 9)))

_UNITS = ("(SELECT unit_id, row_number() OVER (ORDER BY md5(CAST(unit_id AS VARCHAR) || ':42')) AS rn, "
          "count(*) OVER () AS n FROM (SELECT DISTINCT unit_id FROM telemetry) d)")
_TRAIN = f"(SELECT unit_id FROM {_UNITS} u WHERE rn <= floor(n * 0.8))"


def _unit_split(spark, sf, side: str):
    from ..operators.splits import unit_split
    t = T.telemetry(spark, sf)
    train, test = unit_split(t)
    return (train if side == "train" else test).select("unit_id", "time_cycle")


query("unit_split_semi", W(f"SELECT unit_id, time_cycle FROM telemetry WHERE unit_id IN {_TRAIN}", "telemetry"))(
    lambda spark, sf: _unit_split(spark, sf, "train"))
query("unit_split_anti", W(f"SELECT unit_id, time_cycle FROM telemetry WHERE unit_id NOT IN {_TRAIN}", "telemetry"))(
    lambda spark, sf: _unit_split(spark, sf, "test"))


def _row_split(spark, sf):
    from ..operators.splits import row_split_flag
    return row_split_flag(T.telemetry(spark, sf)).select("unit_id", "time_cycle", "is_test")


query("row_split", W("SELECT unit_id, time_cycle, CAST(('0x' || substr(md5(concat_ws(':', CAST(unit_id AS VARCHAR), "
                     "CAST(time_cycle AS VARCHAR), '42')), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) "
                     f"< 0.2 AS is_test FROM telemetry", "telemetry"))(_row_split)

# --------------------------------------------------------------- policy

_STATE_ROWS = (f"SELECT unit_id, time_cycle, RUL, {O.state_sql()} AS state, {O.action_index_sql()} AS action, "
               "CASE WHEN anomaly_flag = -1 THEN 1 ELSE 0 END AS anomaly, "
               f"{O.state_sql('0')} AS rul_band FROM decided")
query("state_encoding", W(f"SELECT unit_id, time_cycle, anomaly, rul_band, state, action FROM ({_STATE_ROWS}) s", DEC))(
    lambda spark, sf: P.with_state(decided(spark, sf)).select("unit_id", "time_cycle", "anomaly", "rul_band", "state",
                                                             "action"))
_TRANS = (f"SELECT unit_id, prev_cycle AS time_cycle, prev_state AS state, prev_action AS action, "
          f"{O.reward_sql('rul_band', 'prev_action', 'anomaly')} AS reward, state AS next_state, "
          "((rul_band = 0 AND prev_action = 3) OR RUL = 0) AS done FROM (SELECT *, lag(state) OVER w AS prev_state, "
          "lag(action) OVER w AS prev_action, lag(time_cycle) OVER w AS prev_cycle FROM (" + _STATE_ROWS + ") s "
          "WINDOW w AS (PARTITION BY unit_id ORDER BY time_cycle)) t WHERE prev_state IS NOT NULL")
_STATS = ("SELECT state, action, next_state, n, mean_reward, n_done, n / sum(n) OVER (PARTITION BY state, action) AS p "
          "FROM (SELECT state, action, next_state, count(*) AS n, avg(reward) AS mean_reward, "
          f"count(*) FILTER (WHERE done) AS n_done FROM ({_TRANS}) t GROUP BY 1, 2, 3) g")
query("transitions", W(_TRANS, DEC))(lambda spark, sf: P.transitions(decided(spark, sf)))
query("transition_stats", W(_STATS, DEC))(lambda spark, sf: P.transition_stats(P.transitions(decided(spark, sf))))

query("transitions_gaps", W(_TRANS.replace("FROM decided", f"FROM decided WHERE {HOLES}"), DEC))(
    lambda spark, sf: P.transitions(_with_holes(decided(spark, sf))))

Q_SWEEPS = 10


def _q_sql(sweeps: int = Q_SWEEPS) -> str:
    spine = ("(SELECT CAST(s.state AS INTEGER) AS state, CAST(a.action AS INTEGER) AS action "
             "FROM range(8) s(state) CROSS JOIN range(4) a(action))")
    ctes = [f"st AS ({_STATS})", f"q0 AS (SELECT state, action, CAST(0 AS DOUBLE) AS q FROM {spine} sp)"]
    for k in range(1, sweeps + 1):
        ctes.append(
            f"q{k} AS (SELECT sp.state, sp.action, coalesce(u.q, CAST(0 AS DOUBLE)) AS q FROM {spine} sp LEFT JOIN "
            f"(SELECT st.state, st.action, sum(st.p * (st.mean_reward + CAST(0.9 AS DOUBLE) * "
            f"coalesce(v.v, CAST(0 AS DOUBLE)))) AS q FROM st LEFT JOIN (SELECT state AS next_state, max(q) AS v "
            f"FROM q{k - 1} GROUP BY state) v ON v.next_state = st.next_state GROUP BY st.state, st.action) u "
            f"ON u.state = sp.state AND u.action = sp.action)")
    return ",\n".join(ctes) + f"\nSELECT state, action, {rx('q', 9)} AS q FROM q{sweeps}"


Q_SQL = W("", DEC).rstrip() + ",\n" + _q_sql()


def q_table(spark, sf):
    q = P.q_values(P.transition_stats(P.transitions(decided(spark, sf))), sweeps=Q_SWEEPS)
    return q.select("state", "action", round_exact("q", 9).alias("q"))


query("q_values", Q_SQL)(q_table)

_NAMES = ", ".join(f"'{n}'" for n in C.POLICY_ACTIONS)
POLICY_SQL = Q_SQL.replace(
    f"\nSELECT state, action, {rx('q', 9)} AS q FROM q{Q_SWEEPS}",
    f",\nqr AS (SELECT state, action, {rx('q', 9)} AS q FROM q{Q_SWEEPS}),\n"
    "pol AS (SELECT state, " + ", ".join(f"max(q) FILTER (WHERE action = {a}) AS q_{n}"
                                         for a, n in enumerate(C.POLICY_ACTIONS))
    + ", CAST(min(action) FILTER (WHERE is_best) AS INTEGER) AS best_action FROM (SELECT *, q = max(q) OVER (PARTITION BY state) "
    "AS is_best FROM qr) x GROUP BY state)\n")
query("policy_table", POLICY_SQL + f"SELECT *, list_extract([{_NAMES}], best_action + 1) AS best_action_name FROM pol")(
    lambda spark, sf: P.greedy_policy(q_table(spark, sf)))
query("policy_apply", POLICY_SQL.replace("WITH ", "WITH ", 1)
      + f"SELECT s.unit_id, s.time_cycle, s.state, s.action, p.best_action, "
        f"list_extract([{_NAMES}], p.best_action + 1) AS best_action_name "
        f"FROM ({_STATE_ROWS}) s LEFT JOIN pol p ON p.state = s.state")(
    lambda spark, sf: P.apply_policy(decided(spark, sf), P.greedy_policy(q_table(spark, sf))))

# --------------------------------------------------------------- messages, monitoring

from ..sources import payload as PL  # noqa: E402

NARROW_REQUEST = ["unit_id", "time_cycle", "sensor_2"]

query("payload_json", W("SELECT event_id, to_json(struct_pack(unit_id := CAST(unit_id AS BIGINT), "
                        "time_cycle := CAST(time_cycle AS BIGINT), sensor_2 := coalesce(CASE WHEN isnan(sensor_2) "
                        "THEN 0.0 ELSE sensor_2 END, CAST(0 AS DOUBLE)))) AS value FROM telemetry", "telemetry"))(
    lambda spark, sf: PL.to_payload(T.telemetry(spark, sf), NARROW_REQUEST).select("event_id", "value"))

_REQ_SQL = ("SELECT event_id, unit_id, time_cycle, CASE WHEN event_id % 50 = 0 THEN NULL ELSE sensor_2 END AS sensor_2, "
            "event_id % 50 <> 0 AS valid FROM telemetry")
REQUESTS_SQL = f"({_REQ_SQL} UNION ALL {_REQ_SQL} WHERE event_id % 40 = 1)"


def decoded_requests(spark, sf):
    return PL.decode(PL.request_fixture(T.telemetry(spark, sf)), PL.request_schema(NARROW_REQUEST))


query("request_validation", W(f"SELECT * FROM {REQUESTS_SQL} r", "telemetry"))(decoded_requests)

_ANOM = "(0.1 - sensor_2 / 500.0 < 0)"


@query("success_rate", W(
    "SELECT requests_total, failures_total, anomalies_total, "
    "CAST(100 AS DOUBLE) * anomalies_total / CAST(greatest(requests_total, 1) AS DOUBLE) AS anomaly_pct, "
    "CAST(100 AS DOUBLE) * (CAST(1 AS DOUBLE) - failures_total / CAST(greatest(requests_total, 1) AS DOUBLE)) AS success_pct "
    "FROM (SELECT count(*) AS requests_total, count(*) FILTER (WHERE NOT valid) AS failures_total, "
    f"count(*) FILTER (WHERE valid AND {_ANOM}) AS anomalies_total FROM {REQUESTS_SQL} r) c", "telemetry"))
def success_rate(spark, sf):
    d = decoded_requests(spark, sf)
    ok = d.where("valid").withColumn("anomaly_flag", F.when(
        F.lit(0.1) - F.col("sensor_2") / F.lit(500.0) < 0, F.lit(-1)).otherwise(F.lit(1)))
    return R.success_rates(R.counters(ok, d.where(~F.col("valid"))))


_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, float("inf")]
_BUCKETS_SQL = ("(SELECT b.idx, b.le, count(s.latency_s) FILTER (WHERE s.latency_s <= b.le) AS cum FROM (VALUES "
                + ", ".join(f"({i}, CAST('{le}' AS DOUBLE))" for i, le in enumerate(_BOUNDS))
                + ") b(idx, le) CROSS JOIN scored s GROUP BY b.idx, b.le)")
query("latency_quantiles", W(
    "SELECT quantile, CASE WHEN total = 0 THEN NULL WHEN le = CAST('inf' AS DOUBLE) THEN prev_le "
    "ELSE prev_le + (le - prev_le) * (rank - prev_cum) / (cum - prev_cum) END AS latency_s FROM ("
    "SELECT q.quantile, x.*, q.quantile * x.total AS rank, row_number() OVER (PARTITION BY q.quantile ORDER BY x.idx) AS rn "
    "FROM (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE)), (CAST(0.99 AS DOUBLE))) q(quantile), "
    "(SELECT idx, le, cum, coalesce(lag(le) OVER (ORDER BY idx), CAST(0 AS DOUBLE)) AS prev_le, "
    f"coalesce(lag(cum) OVER (ORDER BY idx), 0) AS prev_cum, max(cum) OVER () AS total FROM {_BUCKETS_SQL} bb) x "
    "WHERE x.cum >= q.quantile * x.total) h WHERE rn = 1", "scored"))(
    lambda spark, sf: R.histogram_quantiles(R.latency_buckets(T.scored(spark, sf))))


def _ts_utc(col="ts"):
    """Event time as stored (timestamp without zone): windows and hour buckets are
    then wall-clock based and independent of the session time zone."""
    return F.col(col)


@query("rate_windows", W(
    "SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, "
    "count(*) FILTER (WHERE anomaly_flag = -1) AS anomalies, CAST(count(*) AS DOUBLE) / CAST(3600 AS DOUBLE) AS request_rate, "
    "CAST(count(*) FILTER (WHERE anomaly_flag = -1) AS DOUBLE) / CAST(3600 AS DOUBLE) AS anomaly_rate "
    "FROM (SELECT s.*, time_bucket(INTERVAL 15 MINUTE, ts) - k.k * INTERVAL 15 MINUTE AS ws FROM scored s, "
    "range(0, 4) k(k)) w GROUP BY ws", "scored"))
def rate_windows(spark, sf):
    from ..streaming.monitor import rate_windows as rw
    return rw(T.scored(spark, sf).withColumn("ts", _ts_utc()))


@query("cumulative_counters", W(
    "SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS hour_start, requests, anomalies, "
    "CAST(sum(requests) OVER (ORDER BY h) AS BIGINT) AS cum_requests, "
    "CAST(sum(anomalies) OVER (ORDER BY h) AS BIGINT) AS cum_anomalies FROM (SELECT date_trunc('hour', ts) AS h, "
    "count(*) AS requests, count(*) FILTER (WHERE anomaly_flag = -1) AS anomalies FROM scored GROUP BY 1) g", "scored"))
def cumulative_counters(spark, sf):
    s = T.scored(spark, sf).withColumn("h", F.date_trunc("hour", _ts_utc()))
    g = s.groupBy("h").agg(F.count(F.lit(1)).alias("requests"),
                           F.count_if(F.col("anomaly_flag") == -1).alias("anomalies"))
    c = E.cumulative_over_key(g.withColumn("_k", F.unix_seconds("h")), "_k", ["requests", "anomalies"],
                              descending=False)
    return c.select(F.date_format("h", "yyyy-MM-dd HH:mm:ss").alias("hour_start"), "requests", "anomalies",
                    F.col("cum_requests").cast("long").alias("cum_requests"),
                    F.col("cum_anomalies").cast("long").alias("cum_anomalies"))


@query("avg_latency", W(
    f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour_start, "
    f"{rx('sum(latency_s) / greatest(CAST(count(latency_s) AS DOUBLE), 0.001)', 9)} AS avg_latency_s "
    "FROM scored GROUP BY 1", "scored"))
def avg_latency(spark, sf):
    s = T.scored(spark, sf).withColumn("h", F.date_trunc("hour", _ts_utc()))
    a = s.groupBy("h").agg((F.sum("latency_s") / F.greatest(F.count("latency_s").cast("double"),
                                                              F.lit(C.RATE_FLOOR))).alias("v"))
    return a.select(F.date_format("h", "yyyy-MM-dd HH:mm:ss").alias("hour_start"),
                    round_exact("v", 9).alias("avg_latency_s"))


query("selected_unit_replay", W("SELECT unit_id, time_cycle, sensor_2, anomaly_flag, recommended_action FROM decided "
                                "WHERE unit_id = (SELECT min(unit_id) FROM decided)", DEC))(
    lambda spark, sf: R.unit_replay(decided(spark, sf)))


def _validation_split(spark, sf):
    from ..operators.splits import validation_flag
    return validation_flag(T.telemetry(spark, sf)).select("unit_id", "time_cycle", "is_val")


query("validation_split", W("SELECT unit_id, time_cycle, CAST(('0x' || substr(md5(concat_ws(':', CAST(unit_id AS VARCHAR), "
                            "CAST(time_cycle AS VARCHAR), '43')), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) "
                            f"< 0.15 AS is_val FROM telemetry", "telemetry"))(_validation_split)

query("live_records", W("SELECT CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS seq, event_id, unit_id, "
                        "time_cycle, anomaly_flag, predicted_RUL, recommended_action, risk_score, confidence, "
                        "strftime(ts, '%H:%M:%S') AS time_hms FROM "
                        "(SELECT * FROM decided ORDER BY event_id DESC LIMIT 200) l", DEC))(
    lambda spark, sf: R.live_records(decided(spark, sf), 200))

query("latency_quantiles_hourly", W(
    "SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, quantile, CASE WHEN total = 0 THEN NULL "
    "WHEN le = CAST('inf' AS DOUBLE) THEN prev_le ELSE prev_le + (le - prev_le) * (rank - prev_cum) / (cum - prev_cum) END "
    "AS latency_s FROM (SELECT q.quantile, x.*, q.quantile * x.total AS rank, row_number() OVER (PARTITION BY "
    "x.window_start, q.quantile ORDER BY x.idx) AS rn FROM (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE)), "
    "(CAST(0.99 AS DOUBLE))) q(quantile), (SELECT window_start, idx, le, cum, coalesce(lag(le) OVER w, CAST(0 AS DOUBLE)) "
    "AS prev_le, coalesce(lag(cum) OVER w, 0) AS prev_cum, max(cum) OVER (PARTITION BY window_start) AS total FROM "
    "(SELECT date_trunc('hour', s.ts) AS window_start, b.idx, b.le, count(s.latency_s) FILTER (WHERE s.latency_s <= b.le) "
    "AS cum FROM (VALUES " + ", ".join(f"({i}, CAST('{le}' AS DOUBLE))" for i, le in enumerate(_BOUNDS))
    + ") b(idx, le) CROSS JOIN scored s GROUP BY 1, 2, 3) bb WINDOW w AS (PARTITION BY window_start ORDER BY idx)) x "
    "WHERE x.cum >= q.quantile * x.total) h WHERE rn = 1", "scored"))(
    lambda spark, sf: R.windowed_latency_quantiles(T.scored(spark, sf).withColumn("ts", _ts_utc())))
