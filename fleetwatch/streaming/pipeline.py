"""Structured Streaming jobs.

* ``telemetry_stream``  replay of the events table as a stream (file source,
  ``maxFilesPerTrigger``), with the telemetry column names and a zoned ``ts``.
* ``stateful_features`` per-unit cycle counter, rolling mean and first difference
  kept across micro-batches with ``applyInPandasWithState``; the state per unit
  is the cycle count and the last ``window - 1`` readings (bounded).
* ``run_ordered_features``  the same in event-time order, for files in any order: rows wait
  in state until the watermark passes (``event_time``).
* ``run_dedup``         one row per (unit, event), however late its copies come (``seen_keys``).
* ``message_stream``    JSON messages -> typed, validated rows.
* ``run_scoring``       validated messages -> decision columns -> three sinks from
  one persisted micro-batch: scored, alerts (anomalies) and rejects.
* ``run_rates``, ``run_latency``  event-time windows with bounded state; late rows are corrections.

Every sink is written by ``foreachBatch`` into ``batch_id=<id>`` folders with
overwrite, so a replayed micro-batch after a failure rewrites the same folder
(exactly-once output together with the checkpoint).
"""
from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import config as C
from ..functions import decisions as D
from ..functions.numeric import nan_to_null
from ..operators import reports
from ..session import release, shared_path
from ..sources import payload as PL
from ..sources.tables import table_path
from . import monitor
from .event_time import ordered_features, state_on_disk, window_sums
from .seen_keys import TARGET, SeenKeys

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def scratch(spark: SparkSession, name: str) -> str:
    return shared_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def telemetry_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table, one file or a folder of parts, as a stream."""
    path = table_path(sf_dir, "events")
    one = f"{path[:-1]}[{path[-1]}]"  # a pattern for just this path: a plain path would have to be a folder
    return _telemetry(spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(one))


def _telemetry(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("user_id").alias("unit_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
                      "event_type", nan_to_null("value").alias("sensor_2"))


#: Event type of a row that only moves the watermark.
HEARTBEAT = "heartbeat"


def run_dedup(stream: DataFrame, keys=("unit_id", "event_id"), ts: str = "ts", path: str | None = None, target: int = TARGET) -> str:
    """Keep the first copy of every event in a sink partitioned by event day, and no other.

    Copies within a micro-batch go by grouping; those of earlier micro-batches are found among the
    keys of all rows in the sink (see ``seen_keys``).  So a copy is found whatever its timestamp
    (another day, or none) and however late it comes.  Null keys are equal."""
    spark = stream.sparkSession
    base = path or scratch(spark, "stream-dedup")
    sink, seen = f"{base}/sink", SeenKeys(spark, f"{base}/keys", list(keys), target)

    def write(batch: DataFrame, batch_id: int):
        once, out = f"{base}/once/batch_id={batch_id}", f"{sink}/batch_id={batch_id}"
        batch.dropDuplicates(list(keys)).write.mode("overwrite").parquet(once)  # read several times
        new, read = seen.unseen(spark.read.schema(stream.schema).parquet(once), batch_id)
        # a task a day (more for a crowded one), not a file for each day in each task
        new.withColumn("day", F.to_date(ts)).hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(out)
        written = spark.read.schema(T.StructType([stream.schema[k] for k in keys])).parquet(out)
        seen.add(written, batch_id, read)
        release(spark, [f"{base}/once/batch_id={batch_id}"])

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return sink


def stateful_features(stream: DataFrame, sensors=("sensor_2",), window: int = C.ROLLING_WINDOW,
                      order=("ts", "event_id"), assign_cycle: bool = True) -> DataFrame:
    """Per-unit rolling mean / first difference of ``sensors`` across micro-batches.

    State per unit: the number of rows seen and the last ``window - 1`` readings of
    each sensor (bounded).  Rows of a unit inside one micro-batch are ordered by
    ``order``; ``assign_cycle`` numbers them 1..n across batches (else the stream's
    own ``time_cycle`` is kept).  Every other input column passes through."""
    sensors = [s for s in sensors if s in stream.columns]
    keep = window - 1
    base = [f for f in stream.schema.fields if f.name not in sensors and f.name != "time_cycle"]
    fields = [T.StructField("time_cycle", T.LongType())] + base
    fields += [T.StructField(s, T.DoubleType()) for s in sensors]
    for s in sensors:
        fields += [T.StructField(f"{s}_rolling_mean", T.DoubleType()), T.StructField(f"{s}_diff", T.DoubleType())]
    out_schema = T.StructType(fields)
    state_schema = T.StructType([T.StructField("n", T.LongType()),
                                 T.StructField("tails", T.ArrayType(T.ArrayType(T.DoubleType())))])
    names = [f.name for f in out_schema.fields]

    def step(key, pdfs, state):
        # rows of one unit in one micro-batch: bounded by the trigger size
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(list(order), kind="stable")
        n, tails = (state.get[0], [list(t) for t in state.get[1]]) if state.exists else (0, [[] for _ in sensors])
        out = pdf.copy()
        if assign_cycle or "time_cycle" not in out:
            out["time_cycle"] = np.arange(n + 1, n + 1 + len(pdf), dtype=np.int64)
        new_tails = []
        for s, tail in zip(sensors, tails):
            x = pdf[s].to_numpy(dtype=float)
            vals = np.concatenate([np.full(keep - len(tail), np.nan), np.asarray(tail, dtype=float), x])
            win = np.lib.stride_tricks.sliding_window_view(vals, window)
            ok = ~np.isnan(win)
            total = np.zeros(len(win))
            for j in range(window):  # oldest to newest, like the batch frame sum
                total = total + np.where(ok[:, j], win[:, j], 0.0)
            cnt = ok.sum(axis=1)
            out[f"{s}_rolling_mean"] = np.where(cnt > 0, total / np.maximum(cnt, 1), np.nan)
            prev = vals[keep - 1: keep - 1 + len(x)]
            out[f"{s}_diff"] = np.where(np.isnan(x - prev), 0.0, x - prev)
            new_tails.append([float(v) for v in vals[len(vals) - keep:]])  # missing readings keep their places
        state.update((int(n + len(pdf)), new_tails))
        yield out[names]

    return stream.groupBy("unit_id").applyInPandasWithState(
        step, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def _batch_writer(base: str, fmt: str = "parquet"):
    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").format(fmt).save(f"{base}/batch_id={batch_id}")
    return write


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Run ``stream`` until the source is exhausted (``availableNow``)."""
    q = (stream.writeStream.outputMode(mode).foreachBatch(_batch_writer(sink))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def run_features(spark: SparkSession, sf_dir: str) -> str:
    s = telemetry_stream(spark, sf_dir)
    sink, ck = scratch(spark, "stream-features"), scratch(spark, "ckpt-features")
    drain(stateful_features(s.drop("event_type")), sink, ck)
    return sink


def end_of_stream(spark: SparkSession, folder: str, days: int = 2) -> None:
    """A last file for a stream of event files, whose only row moves the watermark past all others."""
    files = spark.read.schema(EVENTS_SCHEMA).parquet(folder)
    last = files.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.make_dt_interval(F.lit(days))).alias("ts"), F.lit(HEARTBEAT).alias("event_type"))
    row = last.select(*[(F.col(f.name) if f.name in ("ts", "event_type") else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENTS_SCHEMA])
    row.write.mode("append").parquet(folder)


def _drained(spark: SparkSession, stream: DataFrame, name: str, close) -> str:
    """Sink of a stream with event-time state; ``close`` then moves the watermark, so that what waits comes out."""
    sink, ck = scratch(spark, f"stream-{name}"), scratch(spark, f"ckpt-{name}")
    with state_on_disk(spark):
        drain(stream, sink, ck)
        if close:
            close()
            drain(stream, sink, ck)
    return sink


def run_ordered_features(spark: SparkSession, stream: DataFrame, delay: str, slot: str, close=None, **kw) -> str:
    """Features in event-time order (see ``event_time``), for files in any order; rows later than
    ``delay`` are in the sink as ``late``."""
    beat = F.col("event_type") == HEARTBEAT
    return _drained(spark, ordered_features(stream, delay=delay, slot=slot, heartbeat=beat, **kw), "ordered", close)


# --- messages -> decisions ---------------------------------------------------------

SCORE_FIELDS = ["unit_id", "time_cycle", "anomaly_score", "anomaly_flag", "predicted_RUL"]


def message_schema() -> T.StructType:
    return T.StructType([T.StructField("unit_id", T.LongType()), T.StructField("time_cycle", T.LongType()),
                         T.StructField("anomaly_score", T.DoubleType()), T.StructField("anomaly_flag", T.IntegerType()),
                         T.StructField("predicted_RUL", T.DoubleType())])


def publish(df: DataFrame, path: str) -> None:
    """Producer: one JSON message per row (the topic stand-in is a folder of text files)."""
    df.select("value").write.mode("overwrite").text(path)


def message_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return PL.decode(raw, message_schema())


COUNTERS = "requests_total long, failures_total long, anomalies_total long"


def run_scoring(spark: SparkSession, path: str) -> dict:
    """Decisions for every valid message; anomalies also to an alert sink; invalid
    messages to a reject sink.  One persisted micro-batch feeds the three writes, and the counts
    are observed on their way there and kept as one row a micro-batch (``counts``; a replay
    overwrites it), so counters never read the sinks again."""
    sinks = {k: scratch(spark, f"stream-{k}") for k in ("scored", "alerts", "rejects", "counts")}

    def write(batch: DataFrame, batch_id: int):
        batch.persist()
        try:
            good, bad = Observation(), Observation()
            ok = D.with_decision(batch.where("valid").drop("valid"))
            ok = ok.observe(good, F.count(F.lit(1)).alias("n"), F.count_if(F.col("anomaly_flag") == -1).alias("anomalies"))
            out = f"{sinks['scored']}/batch_id={batch_id}"
            ok.write.mode("overwrite").parquet(out)
            spark.read.schema(ok.schema).parquet(out).where(F.col("anomaly_flag") == -1).write.mode("overwrite").parquet(
                f"{sinks['alerts']}/batch_id={batch_id}")
            rejects = batch.where(~F.col("valid")).observe(bad, F.count(F.lit(1)).alias("n"))
            rejects.write.mode("overwrite").parquet(f"{sinks['rejects']}/batch_id={batch_id}")
            row = (good.get["n"] + bad.get["n"], bad.get["n"], good.get["anomalies"])
            spark.createDataFrame([row], COUNTERS).coalesce(1).write.mode("overwrite").parquet(f"{sinks['counts']}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    q = (message_stream(spark, path).writeStream.foreachBatch(write)
         .option("checkpointLocation", scratch(spark, "ckpt-scoring")).trigger(availableNow=True).start())
    q.awaitTermination()
    return sinks


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """Totals of all micro-batches: a row a micro-batch is read."""
    names = [f.split()[0] for f in COUNTERS.split(", ")]
    return spark.read.parquet(path).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def run_rates(spark: SparkSession, scored_stream: DataFrame, delay: str = "1 hour", close=None) -> str:
    """Counts per sliding window (see ``event_time.window_sums``).  Read with ``read_rates``."""
    real = F.coalesce(F.col("event_type") != HEARTBEAT, F.lit(True))
    counts = {"requests": real, "anomalies": real & F.coalesce(F.col("anomaly_flag") == -1, F.lit(False))}
    return _drained(spark, window_sums(scored_stream, counts, monitor.WIDTH, monitor.SLIDE, delay), "rates", close)


def run_latency(spark: SparkSession, stream: DataFrame, delay: str = "1 hour", close=None, bounds=C.LATENCY_BUCKETS) -> str:
    """Cumulative latency bucket counts b0, b1, ... (+Inf last) per hour.  Read with ``read_latency_quantiles``."""
    real, x = F.coalesce(F.col("event_type") != HEARTBEAT, F.lit(True)), F.col("latency_s")
    counts = {f"b{i}": real & F.coalesce(x <= b, F.lit(False)) for i, b in enumerate(bounds)} | {f"b{len(bounds)}": real & x.isNotNull(), "rows": real}
    return _drained(spark, window_sums(stream, counts, "1 hour", delay=delay), "latency", close)


def _window_totals(spark: SparkSession, path: str, rows: str) -> DataFrame:
    """Sums per window over its first row and its corrections."""
    parts = spark.read.parquet(path)
    sums = [c for c in parts.columns if c not in ("window_start", "late", "batch_id")]
    return parts.groupBy("window_start").agg(*[F.sum(c).alias(c) for c in sums]).where(F.col(rows) > 0)


def read_latency_quantiles(spark: SparkSession, path: str) -> DataFrame:
    """Quantiles per window."""
    per = _window_totals(spark, path, "rows").drop("rows")
    return reports.window_bucket_quantiles(per.withColumn("window_start", F.to_timestamp("window_start")))


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    return monitor.rates(_window_totals(spark, path, "requests"))


def read_sink(spark: SparkSession, path: str, latest_only: bool = False) -> DataFrame:
    """Union of all micro-batch folders (append sinks) or the last one (complete mode)."""
    df = spark.read.parquet(path)
    if latest_only:
        last = df.agg(F.max("batch_id").alias("_b"))
        df = df.join(F.broadcast(last), F.col("batch_id") == F.col("_b"), "left_semi")
    return df.drop("batch_id")


# --- requests -> fitted models -> response -----------------------------------------

def run_model_scoring(spark: SparkSession, path: str, model_dir: str, stateful: bool = False,
                      files_per_trigger: int = 4) -> dict:
    """Scoring stream: JSON requests (all raw fields required) -> features -> saved
    models -> response rows, plus alert and reject sinks.

    ``stateless`` (the single-request service semantics): each raw micro-batch is
    persisted once and decoded, scored and split inside ``foreachBatch``.
    ``stateful``: rolling features per unit across batches (state operator on the
    decoded stream), rejects from a second query over the same source.
    Decoding inside ``foreachBatch`` also keeps the 26-field JSON predicate out of
    the streaming planner, where its reject filter exhausts the driver heap."""
    from ..operators.models import store
    models = store.load(spark, model_dir)
    schema = PL.request_schema()
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    sinks = {k: scratch(spark, f"stream-model-{k}") for k in ("scored", "alerts", "rejects")}

    def write_scored(scored: DataFrame, batch_id: int):
        out = f"{sinks['scored']}/batch_id={batch_id}"
        scored.write.mode("overwrite").parquet(out)  # computed once; alerts read it back
        spark.read.parquet(out).where("anomaly_detected").write.mode("overwrite").parquet(
            f"{sinks['alerts']}/batch_id={batch_id}")

    def write_rejects(batch: DataFrame, batch_id: int):
        PL.rejected(PL.decode(batch, schema)).write.mode("overwrite").parquet(
            f"{sinks['rejects']}/batch_id={batch_id}")

    if not stateful:
        def write_all(batch: DataFrame, batch_id: int):
            batch.persist()
            try:
                ok = PL.decode(batch, schema).where("valid").drop("valid")
                write_scored(store.response(store.score(store.stateless_features(ok, C.SELECTED_SENSORS), models)),
                             batch_id)
                write_rejects(batch, batch_id)
            finally:
                batch.unpersist()
        q = (raw.writeStream.foreachBatch(write_all).option("checkpointLocation", scratch(spark, "ckpt-model"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return sinks

    valid = PL.decode(raw, schema).where("valid").drop("valid")
    feats = stateful_features(valid, C.SELECTED_SENSORS, order=("time_cycle",), assign_cycle=False)
    q1 = (store.response(store.score(feats, models)).writeStream.foreachBatch(write_scored)
          .option("checkpointLocation", scratch(spark, "ckpt-model")).trigger(availableNow=True).start())
    q1.awaitTermination()
    q2 = (raw.writeStream.foreachBatch(write_rejects).option("checkpointLocation", scratch(spark, "ckpt-model-rej"))
          .trigger(availableNow=True).start())
    q2.awaitTermination()
    return sinks


def topic_stream(spark: SparkSession, path: str | None = None, kafka_servers: str | None = None,
                 topic: str = "telemetry-input", files_per_trigger: int = 4) -> DataFrame:
    """Message source with a ``value`` text column: a broker topic from the earliest
    offset when ``kafka_servers`` is given (needs the Kafka connector on the
    classpath; offsets live in the query checkpoint), else a folder of text files."""
    if kafka_servers:
        return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", kafka_servers)
                .option("subscribe", topic).option("startingOffsets", "earliest").load()
                .select(F.col("value").cast("string").alias("value")))
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def topic_sink(df: DataFrame, path: str | None = None, kafka_servers: str | None = None,
               topic: str = "telemetry-input") -> None:
    """Batch producer to a topic (``value`` column) or to a text folder."""
    if kafka_servers:
        df.select("value").write.format("kafka").option("kafka.bootstrap.servers", kafka_servers) \
            .option("topic", topic).save()
    else:
        publish(df, path)
