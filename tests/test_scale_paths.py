"""Plans and passes that decide how jobs grow: what is computed once, handed on once, or compiled."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetwatch import session
from fleetwatch.operators.models import deep_forest, iforest, rul, training
from fleetwatch.plans import catalog, model_queries
from fleetwatch.sources import files


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def readings(spark, units=4, cycles=45):
    rng = np.random.default_rng(3)
    rows = [(u, c, cycles - c, *map(float, rng.normal(size=2))) for u in range(units) for c in range(1, cycles + 1)]
    return spark.createDataFrame(rows, "unit_id long, time_cycle long, RUL long, a double, b double")


def test_histograms_are_added_up_over_small_batches():
    batches = [pa.record_batch({"x": np.arange(k)}) for k in (3, 0, 4, 5, 1)]
    got = list(deep_forest._together(iter(batches), 6))
    assert [b.num_rows for b in got] == [7, 6]
    assert [v for b in got for v in b.column(0).to_pylist()] == [v for b in batches for v in b.column(0).to_pylist()]
    assert list(deep_forest._together(iter([]), 6)) == []


def test_both_forms_of_a_histogram_agree():
    rng = np.random.default_rng(2)
    node, bins, w = rng.integers(0, 60, 500), rng.integers(0, 256, 500).astype(np.uint8), rng.integers(1, 4, 500).astype(float)
    s = w * rng.normal(size=500)
    dense = deep_forest._histogram(np.tile(node, 40), np.tile(bins, 40), np.tile(w, 40) / 40, np.tile(s, 40) / 40, 60)
    for n_nodes in (60, 1 << 46):  # sorted as one number, and where that has no room
        sparse = deep_forest._histogram(node, bins, w, s, n_nodes)
        for a, b in zip(sparse, dense, strict=True):
            assert np.allclose(a, b)


def test_deep_forest_predicts_once(spark):
    _, metrics, pred = deep_forest.run(readings(spark), ["a", "b"], n_trees=2)
    assert "FlatMapCoGroups" not in plan(pred) and "FlatMapCoGroups" not in plan(metrics)
    assert pred.count() == 180 and pred.where("predicted_RUL IS NULL").isEmpty()


def test_queries_keep_methods_short_enough_to_be_compiled(spark):
    name, limit = session.METHOD_LIMIT
    fn = catalog.query("_limit_probe")(lambda spark, sf: spark.range(1))
    try:
        spark.conf.unset(name)
        fn(spark, "")
        assert spark.conf.get(name) == limit
        spark.conf.set(name, "4000")  # the caller's own stays
        fn(spark, "")
        assert spark.conf.get(name) == "4000"
    finally:
        del catalog.QUERIES["_limit_probe"]
        spark.conf.unset(name)


def test_sequence_features_are_computed_once(spark):
    _, _, pred = rul.sequence_run(readings(spark, units=8), ["a"], max_iter=2, depth=2)
    assert "first(a" not in plan(pred)
    assert pred.count() == 2 * 16  # windows of the test units


def test_isolation_trees_walk_from_node_to_node():
    """Trees of different depths, more rows than walk at once, values that are missing."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2 * iforest.WALK_ROWS + 7, 3))
    x[::50, 1] = np.nan
    grown = [iforest._grow(rng.normal(size=(n, 3)), rng, depth) for n, depth in ((1, 4), (40, 3), (64, 6))]
    width = max(len(g[0]) for g in grown)
    feature, threshold, left, right, path = (np.array([[*g[k], *[-1 if k == 0 else 0] * (width - len(g[k]))] for g in grown]) for k in range(5))
    forest = iforest.Forest(feature, threshold, left, right, path)
    assert forest.depth == 6

    def one(t, row):
        at = 0
        while feature[t, at] >= 0:
            at = left[t, at] if row[feature[t, at]] <= threshold[t, at] else right[t, at]
        return path[t, at]

    want = [np.mean([one(t, row) for t in range(3)]) for row in x]
    assert np.allclose(iforest.mean_path(forest, x), want, rtol=0, atol=1e-12)


def test_facts_hand_every_row_on_once(spark):
    rows = [(1, 5, -1), (1, 5, 1), (2, 1, 1), (None, 4, 1), (3, None, 1)]
    df = spark.createDataFrame(rows, "unit_id long, time_cycle long, flag int")
    got = model_queries._facts(df, F.min("flag").alias("least"))
    assert "Expand" not in plan(got)
    assert got.columns == ["n_rows", "units", "n_keys", "least"] and got.collect() == [(5, 3, 2, -1)]


@pytest.mark.parametrize("exchange", ["epoch", "step"])
def test_no_training_after_the_last_epoch(spark, exchange):
    class Refusing:
        def initial(self, seed):
            return np.ones(2)

        def items(self, batch):
            held = batch.column("is_val").to_numpy(zero_copy_only=False).astype(bool)
            yield held, (batch.column("x").to_numpy(),)

        def gradient(self, weights, items, rng):
            raise AssertionError("the last pass only measures")

        def losses(self, weights, items):
            return (items[0] - weights.sum()) ** 2

    rows = spark.range(40).select("id", (F.col("id") * 1.0).alias("x"), (F.col("id") < 10).alias("is_val"))
    got = training.train(rows, ["id"], Refusing(), training.Schedule(epochs=0, exchange=exchange), tasks=2)
    assert got.weights.tolist() == [1.0, 1.0] and got.history == [np.mean((np.arange(10) - 2.0) ** 2)]


def test_lines_are_split_once(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.createDataFrame([("1 2 0.5 ",), ("  ",), ("1 x 0.5",), ("1 2",)], "value string").write.text(path)
    rows, rejects = files.load_whitespace_table(spark, path, ["unit_id", "time_cycle", "a"])
    assert rows.collect() == [(1, 2, 0.5)]
    assert sorted(map(tuple, rejects.collect())) == [("1 2", "arity"), ("1 x 0.5", "not a number")]
    assert plan(rows).count("split(") <= 2 and plan(rejects).count("split(") <= 2
