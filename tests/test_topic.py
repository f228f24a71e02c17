"""Topic: offsets, order by key, restart, failed writers."""
import os

import pytest
from pyspark.sql import functions as F

from fleetwatch.sources import topic


def _messages(spark, a, b, keys=7):
    return spark.range(a, b, 1, 3).select((F.col("id") % keys).cast("string").alias("key"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("value"), "id")


def _drain(spark, path, sink, ck, **kw):
    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
    q = topic.stream(spark, path, **kw).writeStream.foreachBatch(keep).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()


def _numbers(spark, sink):
    return sorted(int(r.value[1:]) for r in spark.read.parquet(sink).collect())


def test_restart_neither_loses_nor_repeats(spark, tmp_path):
    path, sink, ck = f"{tmp_path}/t", f"{tmp_path}/out", f"{tmp_path}/ck"
    topic.publish(_messages(spark, 0, 300), path, ["id"])
    _drain(spark, path, sink, ck, group="g")
    assert _numbers(spark, sink) == list(range(300))
    first = topic.Log(path).ends()
    topic.publish(_messages(spark, 300, 500), path, ["id"])
    topic.publish(_messages(spark, 500, 520), path, ["id"])
    _drain(spark, path, sink, ck, group="g")
    assert _numbers(spark, sink) == list(range(520))
    rows = spark.read.parquet(sink).select("partition", "offset", "key", "value").collect()
    by = {}
    for r in rows:
        by.setdefault(r.partition, []).append((r.offset, r.key, int(r.value[1:])))
    for messages in by.values():
        messages.sort()
        assert [m[0] for m in messages] == list(range(len(messages)))  # offsets without holes
        for k in {m[1] for m in messages}:
            own = [m[2] for m in messages if m[1] == k]
            assert own == sorted(own)
    assert len({r.key: r.partition for r in rows}) == len({(r.key, r.partition) for r in rows})
    ends = topic.Log(path).ends()
    assert sum(ends.values()) == 520 and topic.committed(path, "g") == {int(p): n for p, n in first.items()}  # noted when the next batch began
    assert spark.read.format(topic.FORMAT).option("path", path).load().count() == 520


def test_latest_offsets_skip_what_was_there(spark, tmp_path):
    path, sink, ck = f"{tmp_path}/t", f"{tmp_path}/out", f"{tmp_path}/ck"
    topic.publish(_messages(spark, 0, 50), path, ["id"])
    _drain(spark, path, sink, ck, starting="latest")
    topic.publish(_messages(spark, 50, 80), path, ["id"])
    _drain(spark, path, sink, ck, starting="latest")
    assert _numbers(spark, sink) == list(range(50, 80))


def test_a_job_that_fails_publishes_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    topic.publish(_messages(spark, 0, 20), path, ["id"])
    bad = _messages(spark, 20, 400).withColumn("value", F.when(F.col("id") == 350, F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    with pytest.raises(Exception):
        topic.publish(bad, path, ["id"])
    assert sum(topic.Log(path).ends().values()) == 20
    assert not os.path.isdir(f"{path}/_staging") or os.listdir(f"{path}/_staging") == []
    topic.publish(_messages(spark, 20, 30), path, ["id"])
    assert spark.read.format(topic.FORMAT).option("path", path).load().count() == 30


def test_stretches_are_cut_at_offsets(spark, tmp_path):
    path = f"{tmp_path}/t"
    for a in range(0, 40, 10):
        topic.publish(_messages(spark, a, a + 10, keys=1), path, ["id"], partitions=1)
    log = topic.Log(path)
    for start, end, split in [(0, 40, 5), (3, 37, 1000), (10, 20, 1), (25, 25, 1)]:
        parts = log.between({"0": start}, {"0": end}, split)
        got = [x for p in parts for b in log.read(p) for x in b.column("offset").to_pylist()]
        assert got == list(range(start, end))
