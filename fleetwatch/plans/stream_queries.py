"""Streaming queries, drained with ``availableNow`` and read back from their sinks.

Drained results equal the batch operators on the same rows, so they share the
batch SQL oracle.
"""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import reports as R
from ..session import materialize
from ..sources import tables as T
from ..sources import topic
from ..streaming import pipeline as S
from ..streaming.live import LiveStore
from .catalog import DEC, ORACLE, W, decided, query


def _features(spark, sf):
    return S.read_sink(spark, S.run_features(spark, sf)).select("unit_id", "time_cycle", "sensor_2", "sensor_2_rolling_mean",
                                                                "sensor_2_diff")


query("stream_features", ORACLE["rolling_features"])(_features)


def _in_files(spark, sf, newest_first: bool = False, files: int = 4) -> str:
    """The events table as a folder of files by time, each time range written after the other."""
    events = T.read_table(spark, sf, "events")
    out = S.scratch(spark, "events-in-files")
    first, last = (r.cast("timestamp").cast("double") for r in (F.min("ts"), F.max("ts")))
    low, high = events.agg(first, last).first()
    part = F.least(F.floor((F.col("ts").cast("timestamp").cast("double") - low) / (max(high - low, 1.0) / files)), F.lit(files - 1))
    for k in sorted(range(files), reverse=newest_first):
        events.where(part == k).write.mode("append").parquet(T.table_path(out, "events"))
    return out


def _in_ranges(spark, folder, files: int = 4):
    """The files of ``_in_files`` as a stream whose micro-batches have a time range's share of them each, so
    there are as many micro-batches however many files a larger table has."""
    n = len(spark.read.parquet(T.table_path(folder, "events")).inputFiles())
    return S.telemetry_stream(spark, folder, files_per_trigger=max(1, -(-n // files)))


def _closing(spark, folder):
    return lambda: S.end_of_stream(spark, T.table_path(folder, "events"), days=400)


query("stream_features_parts", ORACLE["rolling_features"])(lambda spark, sf: _features(spark, _in_files(spark, sf)))


@query("stream_features_any_order", ORACLE["rolling_features"])
def stream_features_any_order(spark, sf):
    """Files newest first: rows wait in state until the watermark has passed them."""
    files = _in_files(spark, sf, newest_first=True)
    sink = S.run_ordered_features(spark, S.telemetry_stream(spark, files), delay="366 days", slot="5 days", close=_closing(spark, files))
    return S.read_sink(spark, sink).select("unit_id", "time_cycle", "sensor_2", "sensor_2_rolling_mean", "sensor_2_diff")


def _redelivered(spark, sf):
    """The events in files, and then all of them once more in files that come later."""
    out = _in_files(spark, sf)
    T.read_table(spark, sf, "events").write.mode("append").parquet(T.table_path(out, "events"))
    return out


@query("stream_dedup_later_batches", "SELECT user_id AS unit_id, event_id, value AS sensor_2 FROM events")
def stream_dedup_later_batches(spark, sf):
    """Every event comes again in a later micro-batch and is found among the stored keys."""
    sink = S.run_dedup(S.telemetry_stream(spark, _redelivered(spark, sf)))
    return spark.read.parquet(sink).select("unit_id", "event_id", "sensor_2")


def _deduplicated(spark, sf):
    """The events table replayed twice (at-least-once delivery): one copy stays."""
    return S.run_dedup(S.telemetry_stream(spark, sf).unionByName(S.telemetry_stream(spark, sf)))


@query("stream_dedup", W("SELECT unit_id, time_cycle, event_id, sensor_2 FROM telemetry", "telemetry"))
def stream_dedup(spark, sf):
    """One copy of every event, numbered by the stateful counter."""
    clean = _deduplicated(spark, sf)
    once = spark.readStream.schema(spark.read.parquet(clean).schema).option("recursiveFileLookup", "true").parquet(clean)
    sink, ck = S.scratch(spark, "stream-numbered"), S.scratch(spark, "ckpt-numbered")
    S.drain(S.stateful_features(once.select("unit_id", "event_id", "ts", "sensor_2")), sink, ck)
    return S.read_sink(spark, sink).select("unit_id", "time_cycle", "event_id", "sensor_2")


@query("stream_dedup_out_of_order", "SELECT user_id AS unit_id, event_id, value AS sensor_2 FROM events")
def stream_dedup_out_of_order(spark, sf):
    """The newest file comes first, so all other rows are days late."""
    sink = _deduplicated(spark, _in_files(spark, sf, newest_first=True))
    return spark.read.parquet(sink).select("unit_id", "event_id", "sensor_2")


def _published(spark, sf):
    d = decided(spark, sf)
    body = F.struct(F.col("unit_id"), F.col("time_cycle"), F.col("anomaly_score"), F.col("anomaly_flag"),
                    F.when(F.col("event_id") % 50 == 0, F.lit(None).cast("double"))
                    .otherwise(F.col("predicted_RUL")).alias("predicted_RUL"))
    path = S.scratch(spark, "topic")
    S.publish(d.select(F.to_json(body).alias("value")), path)
    return S.run_scoring(spark, path)


@query("stream_decisions", W("SELECT unit_id, time_cycle, recommended_action, risk_score, confidence, justification "
                             "FROM decided WHERE event_id % 50 <> 0", DEC))
def stream_decisions(spark, sf):
    sinks = _published(spark, sf)
    return S.read_sink(spark, sinks["scored"]).select("unit_id", "time_cycle", "recommended_action", "risk_score",
                                                      "confidence", "justification")


@query("stream_sink_counts", W("SELECT count(*) FILTER (WHERE event_id % 50 <> 0) AS scored, "
                               "count(*) FILTER (WHERE event_id % 50 <> 0 AND anomaly_flag = -1) AS alerts, "
                               "count(*) FILTER (WHERE event_id % 50 = 0) AS rejects FROM decided", DEC))
def stream_sink_counts(spark, sf):
    sinks = _published(spark, sf)
    counts = [S.read_sink(spark, sinks[k]).agg(F.count(F.lit(1)).alias(k)) for k in ("scored", "alerts", "rejects")]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


@query("stream_topic", W("SELECT unit_id, time_cycle, sensor_2, TRUE AS in_order FROM telemetry", "telemetry"))
def stream_topic(spark, sf):
    """Telemetry published to a topic in two goes, read by a query that is stopped in between: every
    message once, and those of a unit in the order of their cycles."""
    t = materialize(T.telemetry(spark, sf), "telemetry")
    body = F.struct("unit_id", "time_cycle", "sensor_2")
    messages = t.select(F.col("unit_id").cast("string").alias("key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value"), "time_cycle")
    path, sink, ck = (S.scratch(spark, n) for n in ("topic", "topic-read", "ckpt-topic"))
    for early in (True, False):
        topic.publish(messages.where((F.col("time_cycle") <= 30) == early), path, ["time_cycle"])
        S.drain(topic.stream(spark, path, group="telemetry"), sink, ck)
    read = S.read_sink(spark, sink).withColumn("m", F.from_json("value", "unit_id long, time_cycle long, sensor_2 double"))
    before = F.lag("m.time_cycle").over(Window.partitionBy("partition", "m.unit_id").orderBy("offset"))
    return read.select("m.*", F.coalesce(before < F.col("m.time_cycle"), F.lit(True)).alias("in_order"))


def _flagged(stream):
    return stream.withColumn("anomaly_flag", F.when(F.lit(0.1) - F.col("sensor_2") / F.lit(500.0) < 0, F.lit(-1))
                             .otherwise(F.lit(1)))


def _rates(spark, sf, newest_first=False):
    """All windows of a stream of files, after a last row that closes them."""
    files = _in_files(spark, sf, newest_first)
    return S.read_rates(spark, S.run_rates(spark, _flagged(_in_ranges(spark, files)), close=_closing(spark, files)))


query("stream_rates", ORACLE["rate_windows"])(_rates)
query("stream_rates_out_of_order", ORACLE["rate_windows"])(lambda spark, sf: _rates(spark, sf, newest_first=True))


@query("stream_live_store", "SELECT event_id, user_id AS unit_id, value AS sensor_2, "
       "CASE WHEN 0.1 - value / 500.0 < 0 THEN -1 ELSE 1 END AS anomaly_flag FROM events ORDER BY event_id DESC LIMIT 500")
def stream_live_store(spark, sf):
    """The newest records of a stream of files in any order, after a compaction."""
    store = LiveStore(spark, S.scratch(spark, "live"))
    stream = _flagged(S.telemetry_stream(spark, _in_files(spark, sf, newest_first=True)))
    (stream.select("event_id", "unit_id", "sensor_2", "anomaly_flag").writeStream.foreachBatch(store.append)
     .option("checkpointLocation", S.scratch(spark, "ckpt-live")).trigger(availableNow=True).start().awaitTermination())
    store.compact()
    return store.read()


@query("stream_latency_quantiles", ORACLE["latency_quantiles_hourly"])
def stream_latency_quantiles(spark, sf):
    """Latency quantiles per window over a stream whose files come newest first."""
    files = _in_files(spark, sf, newest_first=True)
    stream = _in_ranges(spark, files).withColumn("latency_s", F.col("sensor_2") / F.lit(1000.0))
    return S.read_latency_quantiles(spark, S.run_latency(spark, stream, close=_closing(spark, files)))


@query("stream_failures", W("SELECT count(*) AS requests_total, count(*) FILTER (WHERE event_id % 50 = 0) AS failures_total, "
                            "count(*) FILTER (WHERE event_id % 50 <> 0 AND anomaly_flag = -1) AS anomalies_total FROM decided", DEC))
def stream_failures(spark, sf):
    """Requests, failures and anomalies, observed while the scoring stream wrote its sinks."""
    return S.read_counters(spark, _published(spark, sf)["counts"])


@query("stream_counters", W("SELECT count(*) AS requests_total, "
                            "count(*) FILTER (WHERE 0.1 - sensor_2 / 500.0 < 0) AS anomalies_total FROM telemetry",
                            "telemetry"))
def stream_counters(spark, sf):
    """Cumulative counters over the replayed stream (one-row state, complete mode)."""
    from ..streaming import monitor
    scored = _flagged(S.telemetry_stream(spark, sf))
    sink, ck = S.scratch(spark, "stream-counters"), S.scratch(spark, "ckpt-counters")
    S.drain(monitor.counter_totals(scored), sink, ck, mode="complete")
    return S.read_sink(spark, sink, latest_only=True)
