"""Drained streams equal the batch operators."""
import __spark_entry__ as E
from conftest import SF_SMALL


def _same(spark, a, b):
    qa = E.queries()[a](spark, SF_SMALL)
    qb = E.queries()[b](spark, SF_SMALL)
    cols = sorted(qa.columns)
    assert cols == sorted(qb.columns)
    assert sorted(qa.select(*cols).collect()) == sorted(qb.select(*cols).collect())


def test_stateful_stream_equals_batch_windows(spark):
    _same(spark, "stream_features", "rolling_features")


def test_stream_rates_equal_batch(spark):
    _same(spark, "stream_rates", "rate_windows")


def test_dedup_removes_replayed_copies(spark):
    d = E.queries()["stream_dedup"](spark, SF_SMALL)
    assert d.count() == d.select("event_id").distinct().count()
    assert d.count() == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()


def test_scoring_sinks(spark):
    c = E.queries()["stream_sink_counts"](spark, SF_SMALL).first()
    n = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert c.scored + c.rejects == n and c.rejects > 0 and 0 < c.alerts < c.scored


def test_dedup_finds_copies_of_another_day_or_without_timestamp(spark, tmp_path):
    from datetime import datetime
    from fleetwatch.streaming import pipeline as S
    day, next_day = datetime(2024, 1, 1, 23, 59), datetime(2024, 1, 2, 0, 1)
    batches = [[(1, 1, day), (1, 2, None), (2, 1, day), (None, 7, day)],
               [(1, 1, next_day), (1, 2, None), (2, 2, next_day), (None, 7, None)],
               [(2, 2, day), (1, 2, day), (2, 1, None), (3, 1, None), (3, 1, None)],
               []]
    schema = "unit_id long, event_id long, ts timestamp"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink = S.run_dedup(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    got = spark.read.parquet(sink).select("unit_id", "event_id", "ts").collect()
    first = [(1, 1, day), (1, 2, None), (2, 1, day), (None, 7, day), (2, 2, next_day), (3, 1, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, first))
