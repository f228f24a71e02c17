"""Model evaluation: regression metrics, confusion matrix, classification report,
exact ROC-AUC and average precision.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_exact
from ..session import materialize, recorded, release


def regression_metrics(df: DataFrame, y: str = "RUL", yhat: str = "predicted_RUL") -> DataFrame:
    """MAE, MSE, RMSE, R2 in one aggregate (R2 = 1 - SSE / SST, SST = n var_pop(y);
    a constant target gives 1 for a perfect fit and 0 otherwise)."""
    e = F.col(yhat).cast("double") - F.col(y).cast("double")
    a = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("MAE"),
        F.avg(e * e).alias("MSE"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(F.col(y).cast("double")) * F.count(F.lit(1))).alias("_sst"))
    r2 = (F.when(F.col("_sst") > 0, F.lit(1.0) - F.col("_sse") / F.col("_sst"))
          .when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return a.select("n", "MAE", "MSE", F.sqrt("MSE").alias("RMSE"), r2.alias("R2"))


def metrics_long(metrics: DataFrame, model: str) -> DataFrame:
    """(model, metric, value) rows from a one-row metric frame."""
    names = [c for c in ("MAE", "MSE", "RMSE", "R2") if c in metrics.columns]
    pairs = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in names)
    return metrics.selectExpr(f"'{model}' AS model", f"stack({len(names)}, {pairs}) AS (metric, value)")


def model_comparison(long_metrics: DataFrame, models=("RF", "LSTM"), metrics=("MAE", "RMSE", "R2")) -> DataFrame:
    """Metric x model grid; a missing metric stays NULL (NaN in the text sink)."""
    spine = long_metrics.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    piv = (long_metrics.where(F.col("metric").isin(list(metrics)))
           .groupBy("metric").pivot("model", list(models)).agg(F.first("value")))
    return spine.join(F.broadcast(piv), "metric", "left")


def confusion_matrix(df: DataFrame, actual: str = "true_anomaly", predicted: str = "pred_anomaly") -> DataFrame:
    """2 x 2 matrix as (actual, predicted, n); empty cells are 0."""
    counts = (df.groupBy(F.col(actual).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted"))
              .agg(F.count(F.lit(1)).alias("n")))
    spark = df.sparkSession
    spine = spark.range(2).select(F.col("id").cast("int").alias("actual")).crossJoin(
        spark.range(2).select(F.col("id").cast("int").alias("predicted")))
    return (spine.join(F.broadcast(counts), ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def classification_report(cm: DataFrame, digits: int = 4) -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted
    averages from a 2 x 2 confusion table (zero division gives 0)."""
    c = cm.agg(*[F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("n")).otherwise(0))
                 .cast("double").alias(f"c{a}{p}") for a in (0, 1) for p in (0, 1)])

    def div(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    rows = []
    for k in (0, 1):
        tp = F.col(f"c{k}{k}")
        fp = F.col(f"c{1 - k}{k}")
        fn = F.col(f"c{k}{1 - k}")
        p = div(tp, tp + fp)
        r = div(tp, tp + fn)
        rows.append((str(k), p, r, div(2 * p * r, p + r), tp + fn))
    total = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    s0, s1 = rows[0][4], rows[1][4]
    acc = div(F.col("c00") + F.col("c11"), total)
    macro = tuple((rows[0][i] + rows[1][i]) / 2 for i in (1, 2, 3))
    weighted = tuple(div(rows[0][i] * s0 + rows[1][i] * s1, total) for i in (1, 2, 3))
    structs = [F.struct(F.lit(lbl).alias("label"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1_score"), s.alias("support"))
               for lbl, p, r, f, s in rows]
    structs.append(F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                            F.lit(None).cast("double").alias("recall"), acc.alias("f1_score"), total.alias("support")))
    structs.append(F.struct(F.lit("macro avg").alias("label"), macro[0].alias("precision"), macro[1].alias("recall"),
                            macro[2].alias("f1_score"), total.alias("support")))
    structs.append(F.struct(F.lit("weighted avg").alias("label"), weighted[0].alias("precision"),
                            weighted[1].alias("recall"), weighted[2].alias("f1_score"), total.alias("support")))
    out = c.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
    return out.select("label", *[round_exact(x, digits).alias(x) for x in ("precision", "recall", "f1_score")],
                      F.col("support").cast("long").alias("support"))


def cumulative_over_key(g: DataFrame, key: str, sums: list, descending: bool = True,
                        buckets: int | None = None) -> DataFrame:
    """Running totals of ``sums`` over the global order of ``key`` (one row per key).

    ``key`` is cut into ``buckets`` ranges by approximate quantiles; the running
    sum runs per range and adds the exact totals of all earlier ranges (a
    ``buckets``-row table, broadcast).  Adds ``cum_<c>`` (inclusive) and
    ``total_<c>`` for every ``c`` in ``sums``.  No step needs one global
    partition, and every row is kept.
    """
    spark = g.sparkSession
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    qs = [i / buckets for i in range(1, buckets)]
    if qs:
        cuts = g.agg(F.percentile_approx(key, qs, 10000).alias("_cuts"))
        g = g.crossJoin(F.broadcast(cuts)).withColumn(
            "_b", F.coalesce(F.size(F.filter(F.col("_cuts"), lambda c: c < F.col(key))), F.lit(0))).drop("_cuts")
    else:
        g = g.withColumn("_b", F.lit(0))
    if descending:
        g = g.withColumn("_b", -F.col("_b"))
    per_b = g.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # <= buckets rows
    everything = Window.partitionBy()
    offs = per_b.select("_b", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums],
                        *[F.sum(f"_t_{c}").over(everything).alias(f"total_{c}") for c in sums])
    order = F.col(key).desc() if descending else F.col(key).asc()
    w = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = g.join(F.broadcast(offs), "_b")
    out = out.withColumns({f"cum_{c}": F.sum(c).over(w) + F.col(f"_o_{c}") for c in sums})
    return out.drop("_b", *[f"_o_{c}" for c in sums])


def _cumulative_by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    """Per distinct score, descending: pos, neg, tp / fp of all scores >= it, P, N."""
    g = (df.where(F.col(score).isNotNull())
         .groupBy(F.col(score).alias("s"))
         .agg(F.sum(F.col(y).cast("long")).alias("pos"),
              F.sum(1 - F.col(y).cast("long")).alias("neg")))
    c = cumulative_over_key(materialize(g, "by-score"), "s", ["pos", "neg"], descending=True)
    return c.withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp", "total_pos": "P", "total_neg": "N"})


def ranking(df: DataFrame, y: str = "true_anomaly", score: str = "reconstruction_error") -> DataFrame:
    """Exact ROC-AUC (trapezoid over distinct thresholds, ties handled) and average precision
    (sum over thresholds of recall step x precision), from one cumulative table."""
    c = _cumulative_by_score(df, y, score)
    area = F.try_divide(F.col("neg"), F.col("N")) * F.try_divide(2 * F.col("tp") - F.col("pos"), 2 * F.col("P"))
    step = F.try_divide(F.col("pos"), F.col("P")) * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    a = c.agg(F.sum(area).alias("auc"), F.sum(step).alias("ap"), F.max("P").alias("P"), F.max("N").alias("N"))
    return a.select(F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("auc")).alias("roc_auc"),
                    F.when(F.col("P") > 0, F.col("ap")).alias("average_precision"))


def roc_auc(df: DataFrame, y: str = "true_anomaly", score: str = "reconstruction_error") -> DataFrame:
    return ranking(df, y, score).select("roc_auc")


def average_precision(df: DataFrame, y: str = "true_anomaly", score: str = "reconstruction_error") -> DataFrame:
    return ranking(df, y, score).select("average_precision")


#: Quantiles on either side of the wanted one between which rows are put in order.
BRACKET = 0.002


def percentile_threshold(df: DataFrame, col: str, q: float, alias: str = "threshold", written: bool = False) -> DataFrame:
    """One row: the exact linear-interpolated percentile (numpy default), distributed.

    The values are written once, unless ``df`` is a written table (``written``), of which one
    column is read.  Approximate quantiles bracket the wanted rank; the
    values below are counted, and only the distinct values inside are ranked (all of them
    if the bracket misses, which its counts tell).  NaN counts as no value.  What is
    written on the way is deleted."""
    spark = df.sparkSession
    with recorded() as tables:
        value = _percentile(df, col, q, written)
    release(spark, tables)
    return spark.range(1).select(F.lit(value).cast("double").alias(alias))


def _percentile(df: DataFrame, col: str, q: float, written: bool) -> float | None:
    v = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).select(F.col(col).cast("double").alias("v"))
    v = v if written else materialize(v, "values")
    n, marks = v.agg(F.count("v"), F.percentile_approx("v", [max(q - BRACKET, 0.0), min(q + BRACKET, 1.0)], 10000)).first()
    if not n:
        return None
    rank = q * (n - 1)
    first, last = math.floor(rank), math.ceil(rank)
    below, inside = v.agg(F.count_if(F.col("v") < marks[0]), F.count_if(F.col("v").between(*marks))).first()
    if not below <= first or not last < below + inside:
        below, marks = 0, (float("-inf"), float("inf"))
    g = materialize(v.where(F.col("v").between(*marks)).groupBy("v").agg(F.count(F.lit(1)).alias("c")), "bracket")
    r = cumulative_over_key(g, "v", ["c"], descending=False)
    # a distinct value covers 0-based ranks [below + cum_c - c, below + cum_c - 1]
    covers = lambda i: (F.col("cum_c") - F.col("c") <= i - below) & (i - below < F.col("cum_c"))
    lo, hi = r.agg(F.min(F.when(covers(first), F.col("v"))), F.max(F.when(covers(last), F.col("v")))).first()
    return lo + (hi - lo) * (rank - first)
