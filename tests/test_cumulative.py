"""Bucketed running sums and exact percentiles against plain computations."""
import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetwatch.operators.evaluate import cumulative_over_key, percentile_threshold


def test_running_sums_match_plain_window(spark):
    rng = np.random.default_rng(11)
    keys = rng.integers(0, 400, size=3000).astype(float) / 7.0  # many ties before the groupBy
    rows = [(float(k), int(rng.integers(0, 2))) for k in keys]
    df = spark.createDataFrame(rows, "k double, y int")
    g = df.groupBy("k").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    for desc in (True, False):
        order = F.col("k").desc() if desc else F.col("k").asc()
        w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        want = sorted(g.select("k", F.sum("a").over(w).alias("ca"), F.sum("b").over(w).alias("cb")).collect())
        for buckets in (1, 3, 8, 50):
            got = cumulative_over_key(g, "k", ["a", "b"], descending=desc, buckets=buckets)
            assert sorted(got.select("k", F.col("cum_a").alias("ca"), F.col("cum_b").alias("cb")).collect()) == want
            tot = got.select("total_a", "total_b").distinct().collect()
            assert len(tot) == 1 and tot[0][0] == sum(r[1] for r in rows)


def test_percentile_matches_numpy(spark):
    rng = np.random.default_rng(4)
    for vals in (rng.normal(size=1001), np.round(rng.normal(size=500), 1), np.array([3.5]), np.array([2.0, 2.0, 7.0])):
        df = spark.createDataFrame([(float(v),) for v in vals], "x double")
        for q in (0.05, 0.5, 0.95):
            got = percentile_threshold(df, "x", q).first()[0]
            assert abs(got - float(np.percentile(vals, q * 100))) < 1e-12, (len(vals), q)
