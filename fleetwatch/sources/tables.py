"""Parquet tables and the telemetry views built on them.

``telemetry``       narrow fleet telemetry from ``events`` (one sensor).
``telemetry_wide``  wide telemetry from ``lineitem`` (settings + six sensors).
``scored``          deterministic stand-in for model outputs on ``telemetry``,
                    so everything downstream of a model has an exact oracle.
``telemetry_ragged`` telemetry with short units, for the sequence skip rule.

The cycle counter is a dense per-unit row number.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null
from ..operators.ordered import number_rows
from ..session import materialize as materialize_table

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def micros(ts: str) -> "F.Column":
    """A timestamp as a number that grows with time."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _with_rul(df: DataFrame) -> DataFrame:
    """RUL from the numbering's unit row count (cycles are dense 1..n, so the last
    cycle is the count): no second pass over the table."""
    return df.withColumn("RUL", (F.col("_rows") - F.col("time_cycle")).cast("long")).drop("_rows")


def telemetry(spark: SparkSession, sf_dir: str, with_rul: bool = False) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("unit_id"), "event_id", "ts", "event_type",
        nan_to_null("value").alias("sensor_2"))
    t = number_rows(ev, "unit_id", ["ts", "event_id"], micros("ts"), total_out="_rows" if with_rul else None)
    cols = ["unit_id", "time_cycle", "event_id", "ts", "event_type", "sensor_2"]
    return _with_rul(t.select(*cols, "_rows")) if with_rul else t.select(*cols)


def telemetry_wide(spark: SparkSession, sf_dir: str, with_rul: bool = False) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    w = li.select(
        F.col("l_suppkey").alias("unit_id"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_discount").alias("op_setting_1"),
        F.col("l_tax").alias("op_setting_2"),
        F.lit(100.0).alias("op_setting_3"),
        F.col("l_quantity").alias("sensor_2"),
        F.col("l_extendedprice").alias("sensor_3"),
        net.alias("sensor_4"),
        (net * (1 + F.col("l_tax"))).alias("sensor_11"),
        (F.col("l_quantity") * F.col("l_discount")).alias("sensor_15"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("sensor_21"))
    w = number_rows(w, "unit_id", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"],
                    micros("l_shipdate"), total_out="_rows" if with_rul else None)
    cols = ["unit_id", "time_cycle", "op_setting_1", "op_setting_2", "op_setting_3",
            "sensor_2", "sensor_3", "sensor_4", "sensor_11", "sensor_15", "sensor_21"]
    return _with_rul(w.select(*cols, "_rows")) if with_rul else w.select(*cols)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = telemetry(spark, sf_dir, with_rul=True)
    score = F.lit(0.1) - F.col("sensor_2") / F.lit(500.0)
    recon = F.col("sensor_2") / F.lit(200.0) + (F.col("event_id") * 37 % 100).cast("double") / F.lit(100.0)
    return (r.withColumn("anomaly_score", score)
            .withColumn("anomaly_flag", F.when(score < 0, F.lit(-1)).otherwise(F.lit(1)))
            .withColumn("predicted_RUL", F.abs(F.col("RUL") + F.col("event_id") % 11 - 5).cast("double"))
            .withColumn("reconstruction_error", recon)
            .withColumn("autoencoder_anomaly_flag", F.when(recon > 1.0, F.lit(1)).otherwise(F.lit(0)))
            .withColumn("latency_s", F.col("sensor_2") / F.lit(1000.0)))


def telemetry_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    return t.where((F.col("unit_id") % 5 != 0) | (F.col("time_cycle") <= 20))


def wide_labeled(spark: SparkSession, sf_dir: str, materialize: bool = False) -> DataFrame:
    """telemetry_wide + RUL + rolling/diff features: the model input table.

    ``materialize`` writes it once to the shared checkpoint folder (reliable,
    lineage cut) for jobs that read it several times (scaler + models)."""
    from ..operators.features import add_telemetry_features
    df = add_telemetry_features(telemetry_wide(spark, sf_dir, with_rul=True))
    return materialize_table(df, "wide-features", large=True) if materialize else df
