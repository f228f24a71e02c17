"""Histogram quantiles: interpolation inside a bucket, first bucket from 0,
+Inf bucket -> largest finite bound."""
from fleetwatch.operators import reports as R


def _manual(values, bounds, q):
    les = list(bounds) + [float("inf")]
    cum = [sum(v <= le for v in values) for le in les]
    total = cum[-1]
    rank = q * total
    for i, c in enumerate(cum):
        if c >= rank:
            prev_le = les[i - 1] if i else 0.0
            prev_c = cum[i - 1] if i else 0
            if les[i] == float("inf"):
                return prev_le
            return prev_le + (les[i] - prev_le) * (rank - prev_c) / (c - prev_c)


def test_quantiles(spark):
    values = [0.001, 0.004, 0.02, 0.02, 0.06, 0.2, 0.3, 0.9, 3.0, 12.0]
    bounds = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
    df = spark.createDataFrame([(v,) for v in values], "latency_s double")
    got = {r.quantile: r.latency_s for r in R.histogram_quantiles(R.latency_buckets(df), (0.1, 0.5, 0.9, 0.99)).collect()}
    for q in (0.1, 0.5, 0.9, 0.99):
        assert abs(got[q] - _manual(values, bounds, q)) < 1e-12, q
    assert got[0.99] == 10.0  # rank lands in the +Inf bucket
