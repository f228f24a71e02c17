"""Quantiles from mergeable sketches, beside the exact ones of ``evaluate``.

A KLL sketch of bounded size stands for all values of a group.  Sketches are stored with their
group and merge without the rows, so quantiles of any union of groups (days to a month, unit
groups to the fleet) come from a few kilobytes a group.  With ``K`` = 200 the rank of an
estimate is off by at most ``RANK_ERROR`` of the rows with 99 % confidence.  NaN and
null count as no value.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy parameter of the sketches, and the rank error it stands for (normalised, two-sided, 99 %).
K = 200
RANK_ERROR = 0.0165


def sketches(df: DataFrame, value: str, by: list[str], k: int = K) -> DataFrame:
    """(by, n, sketch) of each group: one partial aggregate, a sketch a group and task is shuffled."""
    v = F.col(value).cast("double")
    return (df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, k).alias("sketch")))


def merged(stored: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """Stored sketches put together by fewer columns (none: all)."""
    return stored.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def estimate(q: float) -> Column:
    """The quantile ``q`` of each row's sketch."""
    return F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))


def quantiles(stored: DataFrame, qs: list[float]) -> DataFrame:
    """A row per sketch and quantile: quantile, estimate."""
    pairs = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("quantile"), estimate(q).alias("estimate")) for q in qs])).alias("_q")
    return stored.select(*[c for c in stored.columns if c != "sketch"], pairs).select("*", "_q.*").drop("_q")


def rank_errors(df: DataFrame, value: str, estimates: DataFrame, by: list[str]) -> DataFrame:
    """How far the rank of each estimate lies from its quantile, in shares of the group's rows.

    An estimate that is tied covers a range of ranks, which counts as right throughout."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"))
    # a group has a row a quantile here: the join copies each row that many times, map-side aggregated at once
    joined = rows.join(estimates, by) if by else rows.crossJoin(F.broadcast(estimates))
    ranks = joined.groupBy(*by, "quantile", "estimate").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_v") < F.col("estimate")).alias("below"), F.count_if(F.col("_v") <= F.col("estimate")).alias("upto"))
    low, high = F.col("below") / F.col("n"), F.col("upto") / F.col("n")
    off = F.greatest(low - F.col("quantile"), F.col("quantile") - high, F.lit(0.0))
    return ranks.select(*by, "quantile", "n", "estimate", off.alias("rank_error"))
