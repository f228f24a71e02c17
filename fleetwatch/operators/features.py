"""Labels and features: remaining life, rolling / difference features, scaling,
sequence windows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .ordered import BLK, COPY, POS, number_rows, ordered_rows, with_halo


def add_rul(df: DataFrame, unit: str = "unit_id", cycle: str = "time_cycle") -> DataFrame:
    """RUL = last cycle of the unit - cycle.

    The per-unit maximum is a partial (map-side) aggregate; the join back is a
    plain equi-join, so AQE broadcasts the per-unit table when its measured size
    is small and splits a hot unit with its skew-join rule otherwise.
    """
    last = df.groupBy(unit).agg(F.max(cycle).alias("_max_cycle"))
    return (df.join(last, unit, "left")
            .withColumn("RUL", (F.col("_max_cycle") - F.col(cycle)).cast("long"))
            .drop("_max_cycle"))


def ground_truth(df: DataFrame, threshold: int = C.GROUND_TRUTH_RUL_THRESHOLD, rul: str = "RUL") -> DataFrame:
    return df.withColumn("true_anomaly", (F.col(rul) <= threshold).cast("int"))


def add_telemetry_features(df: DataFrame, sensors: list | None = None, window: int = C.ROLLING_WINDOW,
                           unit: str = "unit_id", cycle: str = "time_cycle") -> DataFrame:
    """``{s}_rolling_mean`` (last ``window`` cycles, partial at the start) and
    ``{s}_diff`` (first difference, 0 at the first cycle) for each sensor.

    One exchange and one sort serve all sensors: every column shares one window over
    the unit's rows (or, in crowded units, blocks of them with a halo).
    """
    sensors = [s for s in (sensors or C.SELECTED_SENSORS) if s in df.columns]
    if not sensors:
        return df
    h, w, finish = ordered_rows(df, unit, cycle, halo=max(window - 1, 1))
    frame = w.rowsBetween(-(window - 1), 0)
    cols = {}
    for s in sensors:
        cols[f"{s}_rolling_mean"] = F.avg(s).over(frame)
        cols[f"{s}_diff"] = F.coalesce(F.col(s) - F.lag(s).over(w), F.lit(0.0))
    return finish(h.withColumns(cols))


def feature_columns(df: DataFrame) -> list:
    return [c for c in df.columns if c not in C.NON_FEATURE_COLUMNS]


#: Features of a written table whose statistics are one aggregate: with more, its method is too long to be compiled.
STATS_TOGETHER = 6


def scaler_stats(df: DataFrame, cols: list, written: bool = False) -> DataFrame:
    """One-row table of mean and population std per feature: one pass, or, over a written table, one
    over a few of its columns at a time."""
    step = STATS_TOGETHER if written else max(len(cols), 1)
    parts = []
    for i in range(0, max(len(cols), 1), step):
        aggs = []
        for c in cols[i: i + step]:
            aggs.append(F.avg(c).alias(f"{c}__mean"))
            aggs.append(F.stddev_pop(c).alias(f"{c}__std"))
        parts.append(df.agg(*aggs))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # a row each
    return out


def apply_scaler(df: DataFrame, stats: DataFrame, cols: list) -> DataFrame:
    """z-score with the stored statistics; a zero std divides by 1.

    The statistics table has exactly one row, so broadcasting it is bounded.
    """
    j = df.crossJoin(F.broadcast(stats))
    scaled = {}
    for c in cols:
        sd = F.col(f"{c}__std")
        scaled[c] = (F.col(c) - F.col(f"{c}__mean")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
    return j.withColumns(scaled).drop(*[x for c in cols for x in (f"{c}__mean", f"{c}__std")])


def scale_features(df: DataFrame, cols: list | None = None):
    """Returns (scaled frame, statistics table, feature column list)."""
    cols = cols or feature_columns(df)
    stats = scaler_stats(df, cols)
    return apply_scaler(df, stats, cols), stats, cols


def sequence_summaries(df: DataFrame, features: list, length: int = C.SEQUENCE_LENGTH,
                       unit: str = "unit_id", cycle: str = "time_cycle", label: str = "RUL") -> DataFrame:
    """Sliding windows of ``length`` cycles per unit, stride 1, labelled with the
    label at the last step; windows that would start before the first cycle
    (units shorter than ``length``) are not emitted.

    Windows are summarised in the frame (first, last, mean, min, max, slope per
    feature) instead of materialising (samples x length x features) arrays.
    """
    h, w, finish = ordered_rows(df, unit, cycle, halo=length - 1)
    frame = w.rowsBetween(-(length - 1), 0)
    cols = {"seq_len": F.count(F.lit(1)).over(frame), "seq_start": F.min(cycle).over(frame)}
    for f in features:
        cols[f"{f}__first"] = F.first(f).over(frame)
        cols[f"{f}__last"] = F.col(f)
        cols[f"{f}__mean"] = F.avg(f).over(frame)
        cols[f"{f}__min"] = F.min(f).over(frame)
        cols[f"{f}__max"] = F.max(f).over(frame)
    out = with_slopes(finish(h.withColumns(cols)).where(F.col("seq_len") == length), features, length)
    return out.select(unit, F.col(cycle).alias("end_cycle"), "seq_start", "seq_len", label,
                      *[c for f in features for c in (f"{f}__first", f"{f}__last", f"{f}__mean",
                                                      f"{f}__min", f"{f}__max", f"{f}__slope")])


def with_slopes(df: DataFrame, features: list, length: int) -> DataFrame:
    """The slope of each feature, from the first and last values of its windows."""
    for f in features:
        df = df.withColumn(f"{f}__slope", (F.col(f"{f}__last") - F.col(f"{f}__first")) / F.lit(float(length - 1)))
    return df


def sequence_blocks(df: DataFrame, features: list, length: int = C.SEQUENCE_LENGTH, block: int = 128,
                    unit: str = "unit_id", cycle: str = "time_cycle", label: str = "RUL") -> DataFrame:
    """The windows of ``sequence_summaries`` as blocks of consecutive rows.

    A block has up to ``block`` rows of its own and the ``length - 1`` rows before them, so a
    reading is stored ``1 + (length - 1) / block`` times instead of once for each of its
    ``length`` windows; every row from place ``length`` of the block on ends a window.  Groups are
    bounded, so a hot unit is just many blocks.  Per block: its number, the cycles and labels of
    its rows in order, and their readings one row after the other.  Blocks without a window are left out."""
    if block < length:
        raise ValueError("a block must be as long as a window")
    numbered = number_rows(df, unit, [cycle], F.col(cycle).cast("double"), out=POS)
    rows = with_halo(numbered, unit, POS, length - 1, block)
    row = F.struct(F.col(POS).alias("p"), F.col(COPY).alias("copy"), F.col(cycle).cast("long").alias("c"), F.col(label).cast("double").alias("y"),
                   F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    blocks = rows.groupBy(unit, F.col(BLK).cast("long").alias("block")).agg(F.sort_array(F.collect_list(row)).alias("r"))
    own = F.exists("r", lambda r: r["copy"] == 0)
    return (blocks.where(own & (F.size("r") >= length))
            .select(unit, "block", F.col("r.c").alias("cycles"), F.col("r.y").alias("labels"), F.flatten("r.x").alias("readings")))
