"""Event-time state: rows in order, windows that close, whatever order the rows come in.

* ``ordered_features``  per unit, rows wait in state until the watermark has passed their time
  slot; then the slot's rows are numbered and get their rolling means and differences.
  Rows that come after their slot has closed (or have no time) come out as ``late``,
  without a number, so nothing is lost silently.
* ``window_sums``       sums per sliding window: every Arrow batch is summed by window before
  the shuffle, so a crowded window is a few rows; a window's sums wait in state until the
  watermark passes its end, then come out once and leave the state.  Rows for a
  window that has closed come out at once as a correction, so adding up all rows of a
  window is right for any order of arrival.

Both use ``transformWithStateInPandas`` with event-time timers.  The watermark is taken from
the event-time column, which is then dropped: with the column still there Spark would throw
away late rows before these operators see them.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .. import config as C
from ..session import ship_package

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MICROS = 1_000_000


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """The state store that these operators need, for queries that start inside the block."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def seconds(interval: str) -> int:
    """Seconds of an interval such as '15 minutes'."""
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


# --- rows in order -------------------------------------------------------------------

class _Rows:
    """Rows of a unit as arrays: time, tie break, the other columns as JSON, and the sensors."""

    def __init__(self, at: np.ndarray, tie: np.ndarray, rest: np.ndarray, sensors: np.ndarray):
        self.at, self.tie, self.rest, self.sensors = at, tie, rest, sensors

    @classmethod
    def of(cls, pdf: pd.DataFrame, sensors: list[str]) -> "_Rows":
        return cls(pdf["at"].to_numpy(dtype=float), pdf["tie"].to_numpy(), pdf["rest"].to_numpy(), pdf[sensors].to_numpy(dtype=float))

    def take(self, which: np.ndarray) -> "_Rows":
        return _Rows(self.at[which], self.tie[which], self.rest[which], self.sensors[which])

    def packed(self) -> bytes:
        return pickle.dumps((self.at, self.tie, self.rest.tolist(), self.sensors), protocol=5)

    @classmethod
    def unpacked(cls, data: bytes) -> "_Rows":
        at, tie, rest, sensors = pickle.loads(data)
        return cls(at, tie, np.array(rest, object), sensors)

    @classmethod
    def joined(cls, parts: list["_Rows"]) -> "_Rows":
        return cls(*[np.concatenate([getattr(p, x) for p in parts]) for x in ("at", "tie", "rest", "sensors")])

    def __len__(self) -> int:
        return len(self.at)


#: Rows of closed slots that are numbered together; a larger slot goes alone.
GROUP_ROWS = 1 << 14


class _InOrder(StatefulProcessor):
    """State of a unit: rows seen, the last readings, the open slots with their number of chunks, and their
    rows in chunks.  Only the first open slot needs a timer: what it finds is all that is due."""

    def __init__(self, sensors: list[str], window: int, slot: int):
        self.sensors, self.window, self.slot = sensors, window, slot

    def init(self, handle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "n long, tails binary")
        self.open = handle.getValueState("open", "slots binary")
        self.rows = handle.getMapState("rows", "slot long, chunk int", "data binary")

    def _slots(self) -> dict[int, int]:
        return pickle.loads(self.open.get()[0]) if self.open.exists() else {}

    def _keep(self, slots: dict[int, int], timer: bool) -> None:
        if not slots:
            self.open.clear()
            return
        self.open.update((pickle.dumps(slots, protocol=5),))
        if timer:
            self.handle.registerTimer((min(slots) + 1) * self.slot // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        slots = self._slots()
        before, new = min(slots, default=None), False
        for pdf in rows:
            beat = pdf["beat"].to_numpy(dtype=bool)
            got = _Rows.of(pdf[~beat] if beat.any() else pdf, self.sensors)
            slot = np.floor_divide(got.at, self.slot)  # NaN: no time
            late = np.isnan(slot) | ((slot + 1) * self.slot <= passed)
            if late.any():
                yield self._result(key, got.take(late), None)
            for s in map(int, np.unique(slot[~late])):
                n = slots.get(s, 0)
                self.rows.updateValue((s, n), (got.take(~late & (slot == s)).packed(),))
                slots[s], new = n + 1, True
        if new:
            self._keep(slots, before is None or min(slots) < before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        slots = self._slots()
        due = sorted(s for s in slots if (s + 1) * self.slot <= passed)
        if not due:
            return
        n, tails = 0, np.full((len(self.sensors), self.window - 1), np.nan)
        if self.done.exists():
            n, data = self.done.get()
            tails = np.frombuffer(data).reshape(tails.shape).copy()
        group, held = [], 0
        for s in due:
            for k in [(s, c) for c in range(slots.pop(s))]:
                group.append(_Rows.unpacked(self.rows.getValue(k)[0]))
                self.rows.removeKey(k)
                held += len(group[-1])
            if held >= GROUP_ROWS or s == due[-1]:
                waiting = _Rows.joined(group)
                yield self._numbered(key, waiting.take(np.lexsort((waiting.tie, waiting.at))), n, tails)
                n, group, held = n + held, [], 0
        self.done.update((n, tails.tobytes()))
        self._keep(slots, True)

    def _numbered(self, key, rows: _Rows, n: int, tails: np.ndarray) -> pd.DataFrame:
        """The rows after the first ``n``; ``tails``, the readings before them, moves on."""
        keep = self.window - 1
        features = []
        for k in range(len(self.sensors)):
            values = np.concatenate([tails[k], rows.sensors[:, k]])
            frames = np.lib.stride_tricks.sliding_window_view(values, self.window)
            known = ~np.isnan(frames)
            total = np.zeros(len(frames))
            for j in range(self.window):  # oldest to newest, like the batch frame's sum
                total = total + np.where(known[:, j], frames[:, j], 0.0)
            count = known.sum(axis=1)
            step = values[keep:] - values[keep - 1: -1]
            features.append((np.where(count > 0, total / np.maximum(count, 1), np.nan), np.where(np.isnan(step), 0.0, step)))
            tails[k] = values[len(values) - keep:]
        return self._result(key, rows, np.arange(n + 1, n + 1 + len(rows)), features)

    def _result(self, key, rows: _Rows, cycles: np.ndarray | None, features: list | None = None) -> pd.DataFrame:
        n = len(rows)
        out = {"unit_id": pd.array([key[0]] * n, "Int64"), "time_cycle": pd.array([None] * n if cycles is None else cycles, "Int64"), "rest": rows.rest, "late": np.full(n, cycles is None)}
        for k, s in enumerate(self.sensors):
            mean, step = features[k] if features else (np.full(n, np.nan),) * 2
            out |= {s: rows.sensors[:, k], f"{s}_rolling_mean": mean, f"{s}_diff": step}
        return pd.DataFrame(out)

    def close(self) -> None:
        pass


def ordered_features(stream: DataFrame, sensors: tuple[str, ...] = ("sensor_2",), window: int = C.ROLLING_WINDOW, delay: str = "1 day",
                     slot: str = "1 hour", ts: str = "ts", tie: str = "event_id", heartbeat: Column | None = None) -> DataFrame:
    """Cycle numbers, rolling means and first differences of each unit's rows in the order (ts, tie).

    A row may be ``delay`` older than the newest one.  ``slot`` and GROUP_ROWS set how many of a
    unit's rows are in memory at once.  Rows where ``heartbeat`` holds only move the watermark.  The
    result has ``late``; a late row has no cycle and no features.  Units are whole numbers or null."""
    ship_package(stream.sparkSession)
    sensors = tuple(s for s in sensors if s in stream.columns)
    others = [c for c in stream.columns if c not in ("unit_id", *sensors)]
    rest = F.to_json(F.struct(*[F.col(c) for c in others]), {"ignoreNullFields": "false"})
    beat = F.lit(False) if heartbeat is None else F.coalesce(heartbeat, F.lit(False))
    rows = stream.withWatermark(ts, delay).select(
        F.col("unit_id").cast("long").alias("unit_id"), F.unix_micros(ts).alias("at"), F.coalesce(F.col(tie).cast("long"), F.lit(-(1 << 63))).alias("tie"),
        *[F.col(s).cast("double").alias(s) for s in sensors], rest.alias("rest"), beat.alias("beat"))
    fields = [T.StructField("unit_id", T.LongType()), T.StructField("time_cycle", T.LongType()), T.StructField("rest", T.StringType()), T.StructField("late", T.BooleanType())]
    fields += [T.StructField(f"{s}{x}", T.DoubleType()) for s in sensors for x in ("", "_rolling_mean", "_diff")]
    found = rows.groupBy("unit_id").transformWithStateInPandas(_InOrder(list(sensors), window, seconds(slot) * _MICROS), T.StructType(fields), "append", "eventTime")
    told = F.from_json("rest", T.StructType([stream.schema[c] for c in others]))
    return found.withColumn("rest", told).select("unit_id", "time_cycle", "rest.*", *[f.name for f in fields[4:]], "late")


# --- windows -------------------------------------------------------------------------

def _summed(batches: Iterator[pa.RecordBatch], width: int, slide: int) -> Iterator[pa.RecordBatch]:
    """Rows (at, sums...) to one row a window and Arrow batch."""
    for batch in batches:
        known = batch.filter(batch.column("at").is_valid())
        at = known.column("at").to_numpy()
        newest = np.floor_divide(at, slide) * slide
        starts = [newest - k * slide for k in range(-(-width // slide))]
        inside = [s + width > at for s in starts]
        start, place = np.unique(np.concatenate([s[i] for s, i in zip(starts, inside, strict=True)]), return_inverse=True)
        sums = []
        for c in known.schema.names[1:]:
            x = known.column(c).fill_null(0).to_numpy()
            total = np.zeros(len(start), np.int64)
            np.add.at(total, place, np.concatenate([x[i] for i in inside]))
            sums.append(pa.array(total))
        yield pa.RecordBatch.from_arrays([pa.array(start, pa.int64()), *sums], ["start", *known.schema.names[1:]])


class _Windows(StatefulProcessor):
    """State of a window: its sums so far."""

    def __init__(self, names: list[str], width: int):
        self.names, self.width = names, width

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "sums binary")

    def _row(self, start: int, sums: np.ndarray, late: bool) -> pd.DataFrame:
        return pd.DataFrame([[start, *sums.tolist(), late]], columns=["start", *self.names, "late"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end = (int(key[0]) + self.width) // 1000
        sums = np.sum([pdf[self.names].to_numpy(dtype=np.int64).sum(axis=0) for pdf in rows], axis=0)
        if end <= timerValues.getCurrentWatermarkInMs():
            yield self._row(int(key[0]), sums, True)
            return
        if self.sums.exists():
            sums = sums + np.frombuffer(self.sums.get()[0], np.int64)
        else:
            self.handle.registerTimer(end)
        self.sums.update((sums.astype(np.int64).tobytes(),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.sums.exists():
            yield self._row(int(key[0]), np.frombuffer(self.sums.get()[0], np.int64), False)
            self.sums.clear()

    def close(self) -> None:
        pass


def window_sums(stream: DataFrame, sums: dict[str, Column], width: str, slide: str | None = None, delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """(window_start, the sums, late) of whole-number columns over sliding windows.

    A window comes out once when the watermark (the newest time less ``delay``) has passed its
    end, and again as ``late`` for rows that come after that: its sums are the sums over its
    rows.  Rows without a time are in no window."""
    ship_package(stream.sparkSession)
    w, s = seconds(width) * _MICROS, seconds(slide or width) * _MICROS
    names = list(sums)
    rows = stream.withWatermark(ts, delay).select(F.unix_micros(ts).alias("at"), *[c.cast("long").alias(n) for n, c in sums.items()])
    fields = ", ".join(f"`{n}` long" for n in names)
    parts = rows.mapInArrow(lambda b: _summed(b, w, s), f"start long, {fields}")
    found = parts.groupBy("start").transformWithStateInPandas(_Windows(names, w), f"start long, {fields}, late boolean", "append", "eventTime")
    return found.select(F.date_format(F.timestamp_micros("start"), "yyyy-MM-dd HH:mm:ss").alias("window_start"), *names, "late")
