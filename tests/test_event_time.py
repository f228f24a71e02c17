"""Event-time state: order of arrival doesn't matter, late rows are told, state is bounded."""
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetwatch.streaming import event_time as ET
from fleetwatch.streaming import pipeline as S
from fleetwatch.streaming.seen_keys import SeenKeys

START = datetime(2024, 1, 1)
SCHEMA = S.EVENTS_SCHEMA


def _put(spark, folder, rows):
    """Rows (event_id, minutes or None, unit, value) as one file."""
    told = [(e, None if m is None else START + timedelta(minutes=m), u, "view", v, None) for e, m, u, v in rows]
    spark.createDataFrame(told, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _stream(spark, folder):
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return raw.select(F.col("user_id").alias("unit_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").alias("sensor_2"))


def _expected(rows):
    """(event_id, cycle, mean, diff) of rows in the order of time and id."""
    out, units = {}, {}
    for e, m, u, v in sorted(rows, key=lambda r: (r[1], r[0])):
        values = units.setdefault(u, [])
        values.append(v)
        known = [x for x in values[-5:] if x is not None]
        step = None if len(values) == 1 or values[-2] is None or v is None else v - values[-2]
        out[e] = (len(values), sum(known) / len(known) if known else None, step or 0.0)
    return out


@pytest.mark.parametrize("newest_first", [False, True])
def test_features_in_event_time_order(spark, tmp_path, newest_first):
    rnd = random.Random(1)
    rows = [(k, rnd.randrange(600), rnd.choice([None, 1, 2, 3]), rnd.choice([None, 0.5, 2.0, 3.25])) for k in range(120)]
    rows.sort(key=lambda r: r[1], reverse=newest_first)
    for a in range(0, 120, 40):
        _put(spark, f"{tmp_path}/in", rows[a: a + 40])
    close = lambda: S.end_of_stream(spark, f"{tmp_path}/in")
    sink = S.run_ordered_features(spark, _stream(spark, f"{tmp_path}/in"), delay="12 hours", slot="1 hour", close=close)
    got = {r.event_id: (r.time_cycle, r.sensor_2_rolling_mean, r.sensor_2_diff) for r in spark.read.parquet(sink).collect()}
    assert got == _expected(rows)


def test_rows_behind_the_watermark_are_told_as_late(spark, tmp_path):
    _put(spark, f"{tmp_path}/in", [(1, 0, 1, 1.0), (2, 10, 1, 2.0), (3, 300, 1, 3.0)])
    _put(spark, f"{tmp_path}/in", [(4, 400, 1, 4.0)])
    _put(spark, f"{tmp_path}/in", [(5, 20, 1, 5.0), (6, None, 1, 6.0), (7, 410, 1, 7.0)])
    close = lambda: S.end_of_stream(spark, f"{tmp_path}/in")
    sink = S.run_ordered_features(spark, _stream(spark, f"{tmp_path}/in"), delay="1 hour", slot="1 hour", close=close)
    got = {r.event_id: (r.time_cycle, r.late) for r in spark.read.parquet(sink).collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (3, False), 4: (4, False), 7: (5, False), 5: (None, True), 6: (None, True)}


class _Held(dict):
    """A value or map state without Spark."""

    def exists(self):
        return 0 in self

    def get(self):
        return self[0]

    def update(self, value):
        self[0] = value

    def getValue(self, k):
        return self[k]

    updateValue, removeKey = dict.__setitem__, dict.__delitem__


class _Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):
        return _Held()

    getMapState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


@pytest.mark.parametrize("group", [1, 7, 1000])
def test_slots_that_close_together_take_one_timer_and_one_frame(monkeypatch, group):
    monkeypatch.setattr(ET, "GROUP_ROWS", group, raising=False)
    unit, handle = ET._InOrder(["x"], 5, 1000), _Handle()  # slots of a millisecond
    unit.init(handle)
    for first in (50, 0):
        at = [1000 * k for k in range(first, first + 50)]
        pdf = pd.DataFrame({"at": at, "tie": at, "rest": [str(t) for t in at], "x": [float(t) for t in at], "beat": False})
        assert list(unit.handleInputRows((1,), iter([pdf]), _At(0))) == []
    assert handle.timers == [51, 1]  # the earliest open slot's
    early = list(unit.handleExpiredTimer((1,), _At(30), None))
    assert handle.timers[2:] == [31] and sum(map(len, early)) == 30
    frames = early + list(unit.handleExpiredTimer((1,), _At(500), None))
    assert len(frames) == -(-30 // group) + -(-70 // group)
    out = pd.concat(frames)
    assert out["time_cycle"].tolist() == list(range(1, 101)) and out["rest"].tolist() == [str(1000 * k) for k in range(100)]
    assert out["x_diff"].tolist() == [0.0] + [1000.0] * 99 and out["x_rolling_mean"].tolist()[-1] == 97000.0
    assert list(unit.handleExpiredTimer((1,), _At(500), None)) == [] and not unit.rows and not unit.open


def test_state_of_a_long_stream_stays_bounded(spark, tmp_path):
    """Eight files of one unit, each two hours on: only the open slots' rows wait."""
    for k in range(8):
        _put(spark, f"{tmp_path}/in", [(100 * k + j, 120 * k + j, 1, float(j)) for j in range(100)])
    sink, ck = S.scratch(spark, "bounded"), S.scratch(spark, "bounded-ck")
    stream = ET.ordered_features(_stream(spark, f"{tmp_path}/in"), delay="1 hour", slot="30 minutes")
    with ET.state_on_disk(spark):
        q = stream.writeStream.foreachBatch(S._batch_writer(sink)).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
    rows = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert len(rows) >= 8 and max(rows[3:]) <= rows[0] + 12  # chunks and timers, not rows of the history
    assert spark.read.parquet(sink).count() >= 700


@pytest.mark.parametrize("order", [1, -1])
def test_windows_close_once_and_take_late_rows(spark, tmp_path, order):
    rows = [(k, 7 * k, 1, float(k)) for k in range(90)]
    for a in range(0, 90, 30)[::order]:
        _put(spark, f"{tmp_path}/in", rows[a: a + 30])
    flagged = _stream(spark, f"{tmp_path}/in").withColumn("anomaly_flag", F.when(F.col("event_id") % 3 == 0, -1).otherwise(1))
    sink = S.run_rates(spark, flagged, delay="10 minutes", close=lambda: S.end_of_stream(spark, f"{tmp_path}/in"))
    parts = spark.read.parquet(sink)
    once = parts.where("not late").groupBy("window_start").count().where("count > 1")
    assert once.isEmpty() and (order == 1) == parts.where("late").isEmpty()
    want = {}
    for k, m, _, _ in rows:
        for j in range(4):
            start = START + timedelta(minutes=m // 15 * 15 - 15 * j)
            if m < (start - START).total_seconds() / 60 + 60:
                n, bad = want.get(str(start), (0, 0))
                want[str(start)] = (n + 1, bad + (k % 3 == 0))
    assert {r.window_start: (r.requests, r.anomalies) for r in S.read_rates(spark, sink).collect()} == want


def test_window_state_is_evicted(spark, tmp_path):
    for k in range(6):
        _put(spark, f"{tmp_path}/in", [(100 * k + j, 600 * k + j, 1, 1.0) for j in range(50)])
    counts = {"requests": F.lit(1)}
    stream = ET.window_sums(_stream(spark, f"{tmp_path}/in"), counts, "1 hour", "15 minutes", "30 minutes")
    sink, ck = S.scratch(spark, "evicted"), S.scratch(spark, "evicted-ck")
    with ET.state_on_disk(spark):
        q = stream.writeStream.foreachBatch(S._batch_writer(sink)).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
    rows = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert max(rows) <= 3 * rows[0]


# --- keys ------------------------------------------------------------------------------

KEYS = "unit_id long, event_id long"


def _batches(seen, batches):
    spark = seen.spark
    out, reads = [], []
    for b, rows in enumerate(batches):
        table = spark.createDataFrame(rows, KEYS)
        for _ in range(2):  # the second time is a replay
            new, read = seen.unseen(table, b)
            new = sorted(map(tuple, new.collect()), key=str)
            seen.add(spark.createDataFrame(new, KEYS), b, read)
        out.append(new)
        reads.append((read, seen.manifest()["keys"]))
    return out, reads


def test_seen_keys_of_any_earlier_batch_are_found(spark, tmp_path):
    seen = SeenKeys(spark, f"{tmp_path}/keys", ["unit_id", "event_id"], target=40, fan=3)
    rnd = random.Random(2)
    batches = [[(rnd.choice([None, 1, 2]), rnd.randrange(100 * b + 60)) for _ in range(60)] for b in range(7)]
    batches = [sorted(set(b), key=str) for b in batches] + [[]]
    got, _ = _batches(seen, batches)
    known = set()
    for b, new in zip(batches, got, strict=True):
        assert new == sorted(set(b) - known, key=str)
        known |= set(b)
    runs = seen.manifest()["runs"]
    assert sum(r["n"] for r in runs) == len(known) and max(r["level"] for r in runs) >= 1
    assert all(len([r for r in runs if r["level"] == x["level"]]) < 3 for x in runs)


def test_share_of_keys_read_shrinks_as_history_grows(spark, tmp_path):
    seen = SeenKeys(spark, f"{tmp_path}/keys", ["unit_id", "event_id"], target=50, fan=2)
    batches = [[(b, k) for k in range(400)] + ([(b - 1, 1), (b - 1, 2)] if b else []) for b in range(6)]
    got, reads = _batches(seen, batches)
    assert all(new == sorted(((b, k) for k in range(400)), key=str) for b, new in enumerate(got))
    shares = [read / keys for read, keys in reads[1:]]
    assert shares[-1] < shares[0] and shares[-1] < 0.25


def test_a_time_range_is_a_micro_batch_however_many_files_it_has(spark, tmp_path):
    from fleetwatch.plans import stream_queries as Q
    rows = [(i, f"2024-01-{1 + i % 20:02d} 00:00:00", i % 3, "view", float(i)) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    for k in range(2):
        events.repartition(10).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    batches = []
    q = Q._in_ranges(spark, str(tmp_path)).writeStream.foreachBatch(lambda b, i: batches.append(b.count())).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(batches) == 4 and sum(batches) == 400  # 20 before, a file each
