"""Hashed splits are partition-count invariant; NaN / NULL rules."""
import math

from pyspark.sql import functions as F

from fleetwatch.functions.numeric import clip, nan_to_null, null_to_zero
from fleetwatch.operators.splits import row_split_flag, unit_split, validation_flag
from fleetwatch.sources.tables import telemetry
from conftest import SF_SMALL


def test_splits_partition_invariant(spark):
    t = telemetry(spark, SF_SMALL).select("unit_id", "time_cycle")
    ref = None
    for n in (1, 4, 16):
        d = t.repartition(n)
        rows = sorted(row_split_flag(validation_flag(d)).collect())
        train, test = unit_split(d)
        units = (sorted(r[0] for r in train.select("unit_id").distinct().collect()),
                 sorted(r[0] for r in test.select("unit_id").distinct().collect()))
        if ref is None:
            ref = (rows, units)
        assert (rows, units) == ref
    n_units = len(ref[1][0]) + len(ref[1][1])
    assert len(ref[1][0]) == int(n_units * 0.8)
    share = sum(r.is_test for r in ref[0]) / len(ref[0])
    assert 0.15 < share < 0.25


def test_nan_and_null_rules(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (2.5,), (-3.0,)], "x double")
    got = df.select(nan_to_null("x").alias("a"), null_to_zero("x").alias("b"), clip("x", 0, 1).alias("c")).collect()
    assert [r.a for r in got][1:] == [None, 2.5, -3.0] and got[0].a is None
    assert [r.b for r in got] == [0.0, 0.0, 2.5, -3.0]
    assert got[1].c is None and got[2].c == 1.0 and got[3].c == 0.0
