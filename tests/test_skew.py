"""A unit holding a third of all rows is split across many window partitions,
and results equal the plain per-unit window."""
import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetwatch.operators import ordered
from fleetwatch.operators.features import add_rul, add_telemetry_features
from fleetwatch.sources.tables import micros


def _hot_frame(spark, hot_rows=30000, cold_units=60, cold_rows=1000):
    base = dt.datetime(2024, 1, 1)
    hot = spark.range(hot_rows).select(F.lit(1).cast("long").alias("unit_id"), F.col("id").alias("event_id"))
    cold = spark.range(cold_units * cold_rows).select((F.col("id") % cold_units + 2).alias("unit_id"),
                                                      (F.col("id") + hot_rows).alias("event_id"))
    df = hot.unionByName(cold)
    return df.select("unit_id", "event_id",
                     (F.lit(base) + F.make_dt_interval(secs=F.col("event_id") * 37)).alias("ts"),
                     (F.sin(F.col("event_id")) * 100).alias("sensor_2"))


def test_hot_unit_is_split_and_exact(spark, monkeypatch):
    df = _hot_frame(spark)
    n = df.count()
    assert df.where("unit_id = 1").count() * 3 >= n  # one unit holds a third of the rows
    t = ordered.number_rows(df, "unit_id", ["ts", "event_id"], micros("ts"), total_out="rows", limit=2000)
    w = Window.partitionBy("unit_id").orderBy("ts", "event_id")
    ref = df.select("unit_id", "event_id", F.row_number().over(w).cast("long").alias("time_cycle"))
    assert t.select("unit_id", "event_id", "time_cycle").exceptAll(ref).count() == 0
    assert t.where("unit_id = 1 AND rows <> 30000 OR unit_id > 1 AND rows <> 1000").isEmpty()

    # the ranges spread the hot unit, and are few against the rows
    ranges = ordered.with_ranges(df, "unit_id", micros("ts"), 30000, 2000).groupBy("unit_id", ordered.BLK).count()
    assert ranges.where("unit_id = 1").agg(F.max("count")).first()[0] <= 2000
    assert ranges.count() <= n / 100
    h = ordered.with_halo(t, "unit_id", "time_cycle", halo=4, block_size=1024)
    assert h.groupBy("unit_id", ordered.BLK).count().agg(F.max("count")).first()[0] <= 1024 + 4

    monkeypatch.setattr(ordered, "UNIT_ROWS", 2000)
    monkeypatch.setattr(ordered, "DEFAULT_BLOCK", 1024)
    feats = add_telemetry_features(t)
    plain = t.select("unit_id", "time_cycle",
                     F.avg("sensor_2").over(Window.partitionBy("unit_id").orderBy("time_cycle").rowsBetween(-4, 0))
                     .alias("m"))
    joined = feats.join(plain, ["unit_id", "time_cycle"])
    assert joined.where(F.col("m") != F.col("sensor_2_rolling_mean")).count() == 0
    r = add_rul(t)
    assert r.where("unit_id = 1").agg(F.max("RUL")).first()[0] == 29999
