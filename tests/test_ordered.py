"""Block / halo windows equal plain per-unit windows for any block size."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetwatch.operators import ordered
from fleetwatch.operators.features import add_telemetry_features, sequence_summaries
from fleetwatch.sources.tables import telemetry

SF = "/root/testdata/sf0.001"


def _plain(t):
    w = Window.partitionBy("unit_id").orderBy("time_cycle")
    return t.select("unit_id", "time_cycle", F.avg("sensor_2").over(w.rowsBetween(-4, 0)).alias("m"),
                    F.coalesce(F.col("sensor_2") - F.lag("sensor_2").over(w), F.lit(0.0)).alias("d"))


def test_numbering_is_dense_and_ordered(spark):
    t = telemetry(spark, SF)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ref = spark.read.parquet(f"{SF}/events.parquet").select(
        F.col("user_id").alias("unit_id"), "event_id", F.row_number().over(w).cast("long").alias("time_cycle"))
    assert t.select("unit_id", "event_id", "time_cycle").exceptAll(ref).count() == 0
    assert t.count() == ref.count()


def test_halo_blocks_match_plain_window(spark):
    """Also with holes in the cycles, at the borders of blocks and elsewhere."""
    dense = telemetry(spark, SF)
    for t in (dense, dense.where("time_cycle % 7 <> 3 AND time_cycle NOT BETWEEN 14 AND 31").withColumn("time_cycle", F.col("time_cycle") * 3)):
        expect = sorted(_plain(t).collect())
        for block in (7, 16, 4096):
            h, w, finish = ordered.ordered_rows(t, "unit_id", "time_cycle", halo=4, limit=20, block_size=block)
            got = finish(h.select("*", F.avg("sensor_2").over(w.rowsBetween(-4, 0)).alias("m"),
                                  F.coalesce(F.col("sensor_2") - F.lag("sensor_2").over(w), F.lit(0.0)).alias("d")))
            assert sorted(got.select("unit_id", "time_cycle", "m", "d").collect()) == expect, block


def test_transitions_and_sequences_over_holes(spark, monkeypatch):
    from fleetwatch.functions.decisions import with_decision
    from fleetwatch.operators.policy import transitions
    from fleetwatch.sources.tables import scored
    t = with_decision(scored(spark, SF)).where("time_cycle % 5 <> 2")
    plain = sorted(transitions(t).collect())
    sequences = sorted(sequence_summaries(t, ["sensor_2"]).collect())
    monkeypatch.setattr(ordered, "UNIT_ROWS", 20)
    assert sorted(transitions(t).collect()) == plain
    assert sorted(sequence_summaries(t, ["sensor_2"]).collect()) == sequences
    assert len(plain) == t.count() - t.select("unit_id").distinct().count()


def test_features_and_sequences_partition_invariant(spark):
    t = telemetry(spark, SF)
    a = sorted(add_telemetry_features(t).collect())
    b = sorted(add_telemetry_features(t.repartition(13)).collect())
    assert a == b
    s = sequence_summaries(t.withColumn("RUL", F.lit(0)), ["sensor_2"])
    assert s.where("seq_len <> 30").count() == 0
    assert s.count() == t.where("time_cycle >= 30").count()
