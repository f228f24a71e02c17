"""Model queries (rows-only checks: results depend on sampled trees / fitted weights)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import decisions as D
from ..operators import evaluate as E
from ..operators.features import add_rul, apply_scaler, ground_truth, scaler_stats
from ..operators.features import sequence_blocks as blocks_of
from ..operators.models import autoencoder, deep_forest, iforest, lstm, recon, rul
from ..session import materialize
from ..sources import tables as T
from .catalog import WIDE_FEATURES, W, query


def wide_and_scaler(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    wide = T.wide_labeled(spark, sf, materialize=True)
    return wide, materialize(scaler_stats(wide, WIDE_FEATURES, written=True), "scaler")


def scaled_wide(spark: SparkSession, sf: str) -> DataFrame:
    return apply_scaler(*wide_and_scaler(spark, sf), WIDE_FEATURES)


KEYS = ["unit_id", "time_cycle", "RUL"]


@query("iforest_scores")
def iforest_scores(spark, sf):
    return iforest.detect(scaled_wide(spark, sf), WIDE_FEATURES, keep=KEYS)


@query("iforest_flag_share")
def iforest_flag_share(spark, sf):
    s = iforest_scores(spark, sf)
    return s.agg(F.count(F.lit(1)).alias("rows"),
                 F.avg((F.col("anomaly_flag") == -1).cast("double")).alias("flag_share"))


@query("iforest_evaluation")
def iforest_evaluation(spark, sf):
    s = ground_truth(iforest_scores(spark, sf)).withColumn("pred_anomaly", D.anomaly_indicator("anomaly_flag"))
    return E.classification_report(E.confusion_matrix(s))


@query("recon_scores")
def recon_scores(spark, sf):
    return recon.detect(scaled_wide(spark, sf), WIDE_FEATURES, keep=KEYS)


@query("recon_evaluation")
def recon_evaluation(spark, sf):
    return E.ranking(ground_truth(recon_scores(spark, sf)))


@query("rul_forest")
def rul_forest(spark, sf):
    _, metrics, _ = rul.forest_run(scaled_wide(spark, sf), WIDE_FEATURES)
    return E.metrics_long(metrics, "RF")


#: Trees of the deep forest in the registered queries; the operator takes the usual 100.
DEEP_TREES = 20


def _deep(spark, sf):
    return deep_forest.run(scaled_wide(spark, sf), WIDE_FEATURES, n_trees=DEEP_TREES)


@query("rul_deep_forest")
def rul_deep_forest(spark, sf):
    """Forest without a depth limit, all features at every split, on the test rows."""
    _, metrics, _ = _deep(spark, sf)
    return E.metrics_long(metrics, "Deep RF")


@query("rul_sequence")
def rul_sequence(spark, sf):
    """Window summaries and gradient-boosted trees."""
    _, metrics, _ = rul.sequence_run(T.wide_labeled(spark, sf), C.SELECTED_SENSORS)
    return E.metrics_long(metrics, "GBT")


def _lstm(spark, sf):
    """As the batch job fits it: all features, the usual passes with early stopping."""
    return lstm.run(scaled_wide(spark, sf), WIDE_FEATURES)


@query("rul_lstm")
def rul_lstm(spark, sf):
    """Recurrent network over windows of 30 cycles, on the test units."""
    _, metrics, _ = _lstm(spark, sf)
    return E.metrics_long(metrics, "LSTM")


@query("model_comparison_fitted")
def model_comparison_fitted(spark, sf):
    return E.model_comparison(rul_forest(spark, sf).unionByName(rul_lstm(spark, sf)))


@query("sequence_blocks", W("SELECT unit_id, (time_cycle - 1) // 32 AS block, count(*) FILTER (WHERE time_cycle >= 30) AS n_windows, "
                            "CAST(sum(RUL) FILTER (WHERE time_cycle >= 30) AS BIGINT) AS label_sum, max(time_cycle) AS last_cycle, "
                            "count(*) + CASE WHEN (min(time_cycle) - 1) // 32 > 0 THEN 29 ELSE 0 END AS n_rows FROM "
                            "(SELECT *, max(time_cycle) OVER (PARTITION BY unit_id) - time_cycle AS RUL FROM telemetry) t "
                            "GROUP BY unit_id, (time_cycle - 1) // 32 HAVING count(*) FILTER (WHERE time_cycle >= 30) > 0", "telemetry"))
def sequence_blocks(spark, sf):
    """The blocks that hold all 30-cycle windows, 32 rows and their 29 predecessors each."""
    b = blocks_of(add_rul(T.telemetry(spark, sf)), ["sensor_2"], block=32)
    ends = F.slice("labels", 30, F.size("labels"))
    return b.select("unit_id", "block", F.size(ends).cast("long").alias("n_windows"),
                    F.aggregate(ends, F.lit(0.0), lambda a, y: a + y).cast("long").alias("label_sum"),
                    F.array_max("cycles").alias("last_cycle"), F.size("cycles").cast("long").alias("n_rows"))


# What must hold of fitted models whatever they have learned; SQL states it without the model.

_WIDE = "FROM (SELECT *, max(time_cycle) OVER (PARTITION BY unit_id) - time_cycle AS RUL FROM telemetry_wide) t"
_FACTS = "count(*) AS n_rows, count(DISTINCT unit_id) AS units, count(DISTINCT unit_id * 1000000 + time_cycle) AS n_keys"


def _facts(df, *more):
    """One row: n_rows, units, n_keys and ``more`` aggregates of ``df``, a written table.  Distinct values are
    counted apart: one aggregate with both kinds would hand every row on three times."""
    key = F.col("unit_id") * 1_000_000 + F.col("time_cycle")
    rest = df.agg(F.count(F.lit(1)).alias("n_rows"), *more)
    units = df.select("unit_id").distinct().agg(F.count("unit_id").alias("units"))
    keys = df.select(key.alias("_key")).distinct().agg(F.count("_key").alias("n_keys"))
    return rest.crossJoin(F.broadcast(units)).crossJoin(F.broadcast(keys)).select("n_rows", "units", "n_keys", *rest.columns[1:])


@query("iforest_facts", W(f"SELECT {_FACTS}, TRUE AS share_ok, TRUE AS flags_by_sign {_WIDE}", "telemetry_wide"))
def iforest_facts(spark, sf):
    """Every row scored once, about 5 % flagged, and those are the negative scores."""
    s = iforest_scores(spark, sf)
    low = F.col("anomaly_score") < 0
    share = F.avg((F.col("anomaly_flag") == -1).cast("double"))
    return _facts(s, (F.abs(share - 0.05) < 0.005).alias("share_ok"), F.every((F.col("anomaly_flag") == -1) == low).alias("flags_by_sign"))


_HEALTHY = ("count(*) FILTER (WHERE RUL > 50) AS healthy, "
            "count(*) FILTER (WHERE RUL > 50) - 1 - 95 * (count(*) FILTER (WHERE RUL > 50) - 1) // 100 AS healthy_flagged")


def _error_facts(s):
    healthy = F.col("RUL") > C.AUTOENCODER_RUL_THRESHOLD
    flagged = F.count_if(healthy & (F.col("autoencoder_anomaly_flag") == 1))
    return _facts(s, F.count_if(healthy).alias("healthy"), flagged.alias("healthy_flagged"),
                 F.every(F.col("reconstruction_error") >= 0).alias("errors_ok"))


@query("recon_facts", W(f"SELECT {_FACTS}, {_HEALTHY}, TRUE AS errors_ok {_WIDE}", "telemetry_wide"))
def recon_facts(spark, sf):
    """Every row has an error, and as many healthy rows are flagged as lie above their 95th percentile."""
    return _error_facts(recon_scores(spark, sf))


@query("autoencoder_facts", W(f"SELECT {_FACTS}, {_HEALTHY}, TRUE AS errors_ok {_WIDE}", "telemetry_wide"))
def autoencoder_facts(spark, sf):
    return _error_facts(autoencoder_scores(spark, sf))


@query("deep_forest_facts", W(f"SELECT {_FACTS}, count(*) AS in_range, TRUE AS beats_mean {_WIDE}", "telemetry_wide"))
def deep_forest_facts(spark, sf):
    """Every row predicted once, by a mean of labels; learned rows closer than their mean is."""
    _, _, pred = _deep(spark, sf)
    span = pred.agg(F.min("RUL").alias("_lo"), F.max("RUL").alias("_hi"), F.avg("RUL").alias("_mean"))
    s = pred.crossJoin(F.broadcast(span))
    error = F.avg(F.abs(F.col("predicted_RUL") - F.col("RUL"))) < F.avg(F.abs(F.col("_mean") - F.col("RUL")))
    return _facts(s, F.count_if(F.col("predicted_RUL").between(F.col("_lo"), F.col("_hi"))).alias("in_range"), error.alias("beats_mean"))


_RESULT = f"SELECT {_FACTS}, count(*) FILTER (WHERE RUL <= 15) AS true_anomalies, 0 AS decision_mismatches {_WIDE}"


def _result_facts(s):
    """Decisions follow from the scores in the table: worked out again from them."""
    again = D.with_decision(s.select("unit_id", "time_cycle", "true_anomaly", "anomaly_flag", "anomaly_score", "predicted_RUL",
                                     F.struct("recommended_action", "risk_score", "confidence", "justification").alias("told")))
    same = F.struct("recommended_action", "risk_score", "confidence", "justification").eqNullSafe(F.col("told"))
    return _facts(again, F.sum("true_anomaly").alias("true_anomalies"), F.count_if(~same).alias("decision_mismatches"))


query("model_results_facts", W(_RESULT, "telemetry_wide"))(lambda spark, sf: _result_facts(materialize(model_results(spark, sf), "results")))
query("pipeline_facts", W(_RESULT, "telemetry_wide"))(lambda spark, sf: _result_facts(pipeline_results(spark, sf)))


@query("model_results")
def model_results(spark, sf):
    """The results table: scaled features + both detectors + forest RUL + decisions."""
    base = scaled_wide(spark, sf)
    flagged = iforest.detect(base, WIDE_FEATURES)
    both = recon.detect(flagged, WIDE_FEATURES)
    _, _, pred = rul.forest_run(both, WIDE_FEATURES)
    out = ground_truth(D.with_decision(pred))
    return out.select("unit_id", "time_cycle", "RUL", "anomaly_score", "anomaly_flag", "reconstruction_error",
                      "autoencoder_anomaly_flag", "predicted_RUL", "recommended_action", "risk_score", "confidence",
                      "justification", "true_anomaly")


@query("pipeline_results")
def pipeline_results(spark, sf):
    """The whole batch job; returns its results table (written by unit bucket)."""
    from .pipeline import run_batch
    paths = run_batch(spark, sf)
    return spark.read.parquet(paths["results"]).drop("unit_bucket")


@query("stream_model_scoring")
def stream_model_scoring(spark, sf):
    """Requests of all 26 raw fields (wide telemetry padded, producer rules) replayed
    through the scoring stream with the saved models."""
    from ..sources import payload as PL
    from ..streaming import pipeline as S
    from .pipeline import train
    model_dir, _, _, _ = train(spark, sf, autoencoder_epochs=AUTOENCODER_EPOCHS)
    w = T.telemetry_wide(spark, sf)
    w = w.withColumns({c: F.lit(0.0) for c in C.SENSOR_COLUMNS if c not in w.columns})
    topic = S.scratch(spark, "requests")
    S.publish(PL.to_payload(w, C.RAW_COLUMNS), topic)
    sinks = S.run_model_scoring(spark, topic, model_dir)
    return S.read_sink(spark, sinks["scored"]).drop("timestamp")


#: Passes over the healthy rows in the registered query; the batch job takes the usual 50.
AUTOENCODER_EPOCHS = 10


@query("autoencoder_scores")
def autoencoder_scores(spark, sf):
    """Data-parallel dense autoencoder (healthy rows, early stopping) -> error and flag."""
    wide, scaler = wide_and_scaler(spark, sf)
    return autoencoder.detect(wide, WIDE_FEATURES, keep=KEYS, scaler=scaler, epochs=AUTOENCODER_EPOCHS)
