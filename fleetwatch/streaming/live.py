"""The live store: the newest records of a scoring stream, with retention and reset.

Records lie in ``epoch=<n>/batch_id=<id>`` folders under a shared path; readers see the
largest complete epoch.  A micro-batch stores at most its own newest ``size`` records, so a
batch of any size adds a bounded file; ``compact`` moves what is still new enough to the
next epoch and ``reset`` opens an empty one.  An epoch notes the last micro-batch that went
into it, so one that is replayed later is passed over, and it is complete once its first
records are written; only then are the older epochs deleted.  A micro-batch that is
replayed within an epoch overwrites its folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..session import release


class LiveStore:
    def __init__(self, spark: SparkSession, path: str, order: str = "event_id", size: int = C.LIVE_STORE_SIZE):
        self.spark, self.path, self.order, self.size = spark, path, order, size

    def _found(self, pattern: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [f.getPath().toString() for f in fs.globStatus(p) or []]

    def _number(self, path: str, name: str) -> int:
        return int(path.split(f"{name}=")[1].split("/")[0])

    def epoch(self) -> int:
        """The largest epoch whose first records are there."""
        return max([0, *(self._number(p, "epoch") for p in self._found("epoch=*/batch_id=-1/_SUCCESS"))])

    def _through(self, epoch: int) -> int:
        """The last micro-batch that the epoch began with."""
        return max([-1, *(int(p.split("_through-")[1]) for p in self._found(f"epoch={epoch}/_through-*"))])

    def _newest(self, df: DataFrame, n: int) -> DataFrame:
        return df.orderBy(F.col(self.order).desc()).limit(n)

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        epoch = self.epoch()
        if batch_id > self._through(epoch):
            self._newest(batch, self.size).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}/batch_id={batch_id}")

    def read(self, limit: int | None = None) -> DataFrame:
        """The newest min(limit, size) records, newest first."""
        limit = self.size if limit is None else limit
        if limit <= 0:
            raise ValueError("limit must be positive")
        rows = self.spark.read.parquet(f"{self.path}/epoch={self.epoch()}").drop("batch_id")
        return self._newest(rows, min(limit, self.size))

    def _open(self, records: DataFrame) -> None:
        """The next epoch, beginning with ``records``."""
        now = self.epoch()
        seen = [self._through(now), *(self._number(p, "batch_id") for p in self._found(f"epoch={now}/batch_id=*"))]
        after = f"{self.path}/epoch={now + 1}"
        release(self.spark, [after])  # what an attempt that failed has left
        jvm = self.spark.sparkContext._jvm
        note = jvm.org.apache.hadoop.fs.Path(f"{after}/_through-{max(seen)}")
        note.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(note, True).close()
        records.write.mode("overwrite").parquet(f"{after}/batch_id=-1")
        release(self.spark, [p for p in self._found("epoch=*") if self._number(p, "epoch") <= now])

    def compact(self) -> None:
        """Keep the newest ``size`` records as the first of the next epoch."""
        self._open(self._newest(self.read(), self.size))

    def reset(self) -> None:
        """An empty store with the same columns."""
        self._open(self.read().limit(0))
