"""Live store: retention, replayed batches, compaction and reset."""
import pytest

from fleetwatch.streaming.live import LiveStore
from fleetwatch.streaming.pipeline import scratch


def _batch(spark, ids):
    return spark.createDataFrame([(i, i % 3) for i in ids], "event_id long, unit_id long")


def test_live_store(spark):
    store = LiveStore(spark, scratch(spark, "live-test"), size=10)
    store.append(_batch(spark, range(100, 130)), 0)
    store.append(_batch(spark, range(0, 50)), 1)  # older than what is there
    store.append(_batch(spark, range(0, 50)), 1)  # replayed
    assert [r.event_id for r in store.read().collect()] == list(range(129, 119, -1))
    assert [r.event_id for r in store.read(3).collect()] == [129, 128, 127]
    assert [r.event_id for r in store.read(999).collect()] == list(range(129, 119, -1))
    store.compact()
    assert store.epoch() == 1 and [r.event_id for r in store.read().collect()] == list(range(129, 119, -1))
    store.reset()
    assert store.read().count() == 0 and store.read().columns == ["event_id", "unit_id"]
    store.append(_batch(spark, range(0, 50)), 1)  # replayed after the reset
    assert store.read().count() == 0
    store.append(_batch(spark, [7]), 2)
    assert [r.event_id for r in store.read().collect()] == [7]
    with pytest.raises(ValueError):
        store.read(0)


def test_compaction_frees_old_epochs_and_takes_no_batch_twice(spark):
    store = LiveStore(spark, scratch(spark, "live-test"), size=10)
    for b in range(3):
        store.append(_batch(spark, range(5 * b, 5 * b + 5)), b)
    store.compact()
    store.append(_batch(spark, range(10, 15)), 2)  # replayed: its records are in the compacted ones
    store.append(_batch(spark, range(15, 18)), 3)
    assert [r.event_id for r in store.read().collect()] == list(range(17, 7, -1))
    store.compact()
    store.append(_batch(spark, range(15, 18)), 3)
    assert [r.event_id for r in store.read().collect()] == list(range(17, 7, -1))
    assert [p.split("/")[-1] for p in store._found("epoch=*")] == ["epoch=2"]


def test_an_epoch_that_was_not_finished_is_not_seen(spark):
    store = LiveStore(spark, scratch(spark, "live-test"), size=10)
    store.append(_batch(spark, range(5)), 0)
    _batch(spark, [99]).write.parquet(f"{store.path}/epoch=1/batch_id=-1")
    import os
    os.remove(f"{store.path.removeprefix('file:')}/epoch=1/batch_id=-1/_SUCCESS")
    assert store.epoch() == 0 and store.read().count() == 5
    store.compact()
    assert store.epoch() == 1 and sorted(r.event_id for r in store.read().collect()) == list(range(5))
