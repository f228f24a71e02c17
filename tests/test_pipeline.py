"""Batch job + saved models; the scoring stream equals batch scoring with them."""
from pyspark.sql import functions as F

from fleetwatch import config as C
from fleetwatch.operators.models import store
from fleetwatch.plans.pipeline import train
from fleetwatch.sources import payload as PL
from fleetwatch.sources import tables as T
from fleetwatch.streaming import pipeline as S
from conftest import SF_SMALL


def test_stream_scoring_equals_batch(spark):
    model_dir, _, predicted, metrics = train(spark, SF_SMALL, autoencoder_epochs=5)
    assert metrics.first()["n"] > 0
    m = store.load(spark, model_dir)
    w = T.telemetry_wide(spark, SF_SMALL)
    w = w.withColumns({c: F.lit(0.0) for c in C.SENSOR_COLUMNS if c not in w.columns})
    topic = S.scratch(spark, "requests-test")
    S.publish(PL.to_payload(w, C.RAW_COLUMNS), topic)
    sinks = S.run_model_scoring(spark, topic, model_dir)
    got = S.read_sink(spark, sinks["scored"]).drop("timestamp")
    req = PL.decode(spark.read.text(topic), PL.request_schema()).where("valid").drop("valid")
    want = store.response(store.score(store.stateless_features(req, C.SELECTED_SENSORS), m)).drop("timestamp")
    cols = sorted(got.columns)
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())
    assert S.read_sink(spark, sinks["rejects"]).count() == 0
    flags = {r[0] for r in got.select("anomaly_flag").distinct().collect()}
    assert flags <= {1, -1}


def test_missing_model_part_fails(spark):
    import pytest
    with pytest.raises(FileNotFoundError):
        store.load(spark, S.scratch(spark, "no-models"))


def test_stateful_stream_scoring_equals_batch_features(spark):
    from fleetwatch.operators.features import add_telemetry_features
    model_dir, _, _, _ = train(spark, SF_SMALL, autoencoder_epochs=5)
    m = store.load(spark, model_dir)
    w = T.telemetry_wide(spark, SF_SMALL)
    w = w.withColumns({c: F.lit(0.0) for c in C.SENSOR_COLUMNS if c not in w.columns})
    import time
    topic = S.scratch(spark, "requests-stateful")
    payload = PL.to_payload(w, C.RAW_COLUMNS)
    for lo, hi in ((0, 150), (150, 400), (400, 10 ** 9)):  # cycles arrive in order, three micro-batches
        chunk = payload.where((F.col("time_cycle") > lo) & (F.col("time_cycle") <= hi)).coalesce(1)
        chunk.select("value").write.mode("append").text(topic)
        time.sleep(1.1)
    sinks = S.run_model_scoring(spark, topic, model_dir, stateful=True, files_per_trigger=1)
    got = S.read_sink(spark, sinks["scored"]).drop("timestamp")
    from fleetwatch.session import materialize
    req = materialize(PL.decode(spark.read.text(topic), PL.request_schema()).where("valid").drop("valid"), "req")
    want = store.response(store.score(add_telemetry_features(req), m)).drop("timestamp")
    assert spark.read.parquet(sinks["scored"]).select("batch_id").distinct().count() == 3
    cols = sorted(got.columns)
    g, e = sorted(got.select(*cols).collect()), sorted(want.select(*cols).collect())
    assert len(g) == len(e) == w.count()
    assert g == e
