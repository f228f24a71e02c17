"""What the jobs over all rows and features leave on disk."""
import time

import numpy as np
from pyspark.sql import functions as F

from fleetwatch.operators.features import apply_scaler, scaler_stats
from fleetwatch.operators.models import autoencoder, rul, training
from fleetwatch.operators.splits import unit_split
from fleetwatch.session import materialize


def readings(spark, n=600):
    rng = np.random.default_rng(8)
    rows = [(k % 4, k // 4 + 1, 200 - k // 4, float(rng.normal(50, 9)), None if k % 11 == 0 else float(rng.integers(0, 9)), 100.0) for k in range(n)]
    return spark.createDataFrame(rows, "unit_id long, time_cycle long, RUL long, a double, b double, c double")


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    return {f for f in files.split() if "/shuffle_" in f}


def test_rows_scaled_in_the_tasks_train_the_same_network(spark, monkeypatch):
    features, df, dealt = ["a", "b", "c"], readings(spark), []
    stats = scaler_stats(df, features)
    whole = training._dealt

    def seen(rows, *args):
        dealt.append(rows.agg(F.max("a")).first()[0])
        return whole(rows, *args)

    monkeypatch.setattr(training, "_dealt", seen)
    one = autoencoder.fit(apply_scaler(df, stats, features), features, epochs=2, tasks=2)
    two = autoencoder.fit(df, features, epochs=2, tasks=2, scaler=stats)
    assert np.array_equal(one.weights, two.weights) and one.history == two.history
    assert dealt[0] < 10 < dealt[1]  # scaled rows, and rows as they are


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    made = materialize(readings(spark).repartition(3, "unit_id"), "no-shuffles", large=True)
    for _ in range(100):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before and made.count() == 600


def test_unit_split_shuffles_no_rows_of_a_table_with_few_units(spark):
    df = materialize(readings(spark), "split-input")
    for side in unit_split(df):
        join = side._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in join and "SortMergeJoin" not in join
    train, test = unit_split(df)
    assert train.count() + test.count() == 600 and not {r[0] for r in train.select("unit_id").distinct().collect()} & {r[0] for r in test.select("unit_id").distinct().collect()}


def test_window_table_has_no_column_that_follows_from_others(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(rul, "materialize", lambda df, *args, **kw: stored.append(df.columns) or materialize(df, *args, **kw))
    _, _, pred = rul.sequence_run(readings(spark), ["a"], max_iter=1, depth=2)
    assert stored == [["unit_id", "end_cycle", "RUL", "a__first", "a__last", "a__mean", "a__min", "a__max"]]
    off = pred.where(F.col("a__slope") != (F.col("a__last") - F.col("a__first")) / 29)
    assert pred.count() and off.isEmpty()
