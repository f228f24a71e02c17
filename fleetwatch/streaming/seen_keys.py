"""Keys that a stream has delivered, in sorted runs with Bloom filters.

Every micro-batch adds a run of its new keys, in buckets of their hash; when there are
``FAN`` runs of a level, they are merged to one of the next, so a key is rewritten a
number of times that grows with the logarithm of the history.  A run has a bucket per
``TARGET`` keys and a Bloom filter (10 bits a key) per bucket.

A micro-batch asks the filters of the buckets that its keys fall in, and reads only those
buckets of a run where some filter said yes, to compare the keys themselves: new keys cost
filter bits, and copies the bucket they are in.  As the history grows its buckets
grow in number, so that a batch touches a smaller and smaller share of it.

What runs there are after a micro-batch stands in its manifest, a small file.  A replayed micro-batch
starts from the manifest before it, so it finds the same keys and writes the same runs;
runs that neither of the last two manifests names are deleted.  Null keys are equal.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import release, ship_package

TARGET = 1_000_000
FAN = 4
BITS, HASHES = 10, 7
#: Buckets named in a partition filter; beyond that they are joined.
LISTED = 1000


def _places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h = h.view(np.uint64)
    step = (h >> np.uint64(17)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    for k in range(HASHES):
        yield (h + np.uint64(k) * step) % np.uint64(bits)


def _filter(table: pa.Table) -> pa.Table:
    """Bloom filter of one bucket's hashes."""
    h = table.column("h").to_numpy()
    bits = max(64, BITS * len(h))
    on = np.zeros(bits, np.uint8)
    for at in _places(h, bits):
        on[at] = 1
    return pa.table({"bucket": table.column("bucket").slice(0, 1), "n": [len(h)], "bits": [bits], "bloom": pa.array([np.packbits(on).tobytes()], pa.binary())})


def _maybe(asked: pa.Table, filters: pa.Table) -> pa.Table:
    """The asked hashes that a bucket's filter doesn't rule out."""
    if asked.num_rows == 0 or filters.num_rows == 0:
        return asked.select(["run", "bucket", "h"]).slice(0, 0)
    h, bits = asked.column("h").to_numpy(), filters.column("bits")[0].as_py()
    on = np.unpackbits(np.frombuffer(filters.column("bloom")[0].as_py(), np.uint8))
    yes = np.ones(len(h), bool)
    for at in _places(h, bits):
        yes &= on[at] == 1
    return asked.select(["run", "bucket", "h"]).filter(pa.array(yes))


class SeenKeys:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], target: int = TARGET, fan: int = FAN):
        self.spark, self.path, self.keys, self.target, self.fan = spark, path, list(keys), target, fan
        ship_package(spark)

    # --- manifests

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self, before: int | None = None) -> dict:
        """The last manifest (of a micro-batch smaller than ``before``)."""
        p, fs = self._fs("manifest/*")
        ids = [int(f.getPath().getName()) for f in fs.globStatus(p) or []]
        ids = [i for i in ids if before is None or i < before]
        if not ids:
            return {"batch": -1, "runs": [], "read": 0}
        p, fs = self._fs(f"manifest/{max(ids)}")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _write_manifest(self, manifest: dict) -> None:
        p, fs = self._fs(f"manifest/{manifest['batch']}")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    # --- runs

    def _hashed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("h", F.xxhash64(*self.keys))

    def _buckets(self, n: int) -> int:
        return 1 << max(0, (-(-n // self.target) - 1).bit_length())

    def _run(self, run: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/runs/{run['name']}/keys")

    def _write_run(self, rows: DataFrame, name: str, level: int) -> dict | None:
        """``rows`` (keys, h) as a run: sorted keys in buckets, and the buckets' filters."""
        n = rows.count()
        if n == 0:
            return None
        run, at = {"name": name, "level": level, "n": n, "buckets": self._buckets(n)}, f"{self.path}/runs/{name}"
        bucket = F.pmod("h", F.lit(run["buckets"])).alias("bucket")
        rows.select(*self.keys, "h", bucket).repartition("bucket").sortWithinPartitions("bucket", "h").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/keys")
        self._run(run).select("h", "bucket").groupBy("bucket").applyInArrow(_filter, "bucket int, n long, bits long, bloom binary").write.mode("overwrite").parquet(f"{at}/filters")
        return run

    # --- micro-batches

    def unseen(self, rows: DataFrame, batch_id: int) -> tuple[DataFrame, int]:
        """Rows whose keys no earlier micro-batch had, and how many stored keys were read for that.

        ``rows`` has one row a key and should be a written table: it is read several times."""
        runs = self.manifest(batch_id)["runs"]
        if not runs:
            return rows, 0
        asked = self._hashed(rows.select(*self.keys))
        n = rows.count()
        of_run = F.explode(F.array(*[F.struct(F.lit(k).alias("run"), F.pmod("h", F.lit(r["buckets"])).cast("int").alias("bucket"),
                                             F.pmod(F.shiftright("h", 40), F.lit(self._parts(n, r))).cast("int").alias("part")) for k, r in enumerate(runs)]))
        asked_of = asked.select("h", of_run.alias("at")).select("at.run", "at.bucket", "at.part", "h")
        filters = None
        for k, r in enumerate(runs):
            parts = F.explode(F.sequence(F.lit(0), F.lit(self._parts(n, r) - 1))).alias("part")
            f = self.spark.read.parquet(f"{self.path}/runs/{r['name']}/filters").select(F.lit(k).alias("run"), "bucket", parts, "bits", "bloom")
            filters = f if filters is None else filters.unionByName(f)
        names = ["run", "bucket", "part"]
        maybe = asked_of.groupBy(*names).cogroup(filters.groupBy(*names)).applyInArrow(_maybe, "run int, bucket int, h long")
        at = f"{self.path}/maybe/{batch_id}"
        maybe.write.mode("overwrite").parquet(at)
        maybe = self.spark.read.parquet(at)
        sizes = maybe.groupBy("run").agg(F.count_distinct("bucket").alias("n")).collect()  # a row a run
        read, copies = 0, None
        for r in sizes:
            run, of = runs[r.run], maybe.where(F.col("run") == r.run)
            stored, touched = self._run(run), of.select("bucket").distinct()
            if r.n <= LISTED:  # a partition filter: other buckets aren't opened
                stored = stored.where(F.col("bucket").isin([x.bucket for x in touched.collect()]))
            else:
                stored = stored.join(touched, "bucket", "left_semi")
            read += run["n"] * r.n // run["buckets"]
            stored = stored.join(of.select("h").distinct(), "h", "left_semi").select(*self.keys, "h")
            copies = stored if copies is None else copies.unionByName(stored)
        if copies is None:
            return rows, 0
        copies = copies.select(*[F.col(k).alias(f"seen_{k}") for k in self.keys], F.col("h").alias("seen_h"))
        new = self._hashed(rows).join(copies, [F.col("h") == F.col("seen_h"), *[F.col(k).eqNullSafe(F.col(f"seen_{k}")) for k in self.keys]], "left_anti")
        return new.drop("h"), read

    def _parts(self, n: int, run: dict) -> int:
        """Groups that a bucket's questions are dealt out to, each with the bucket's filter."""
        return max(1, -(-n // (run["buckets"] * self.target)))

    def add(self, new: DataFrame, batch_id: int, read: int = 0) -> None:
        """The keys of a micro-batch's new rows, written down; merges what has to be merged."""
        before = self.manifest(batch_id)
        runs = list(before["runs"])
        added = self._write_run(self._hashed(new.select(*self.keys)), f"{batch_id}-0", 0)
        if added:
            runs.append(added)
        level = 0
        while len(same := [r for r in runs if r["level"] == level]) >= self.fan:
            union = None
            for r in same:
                part = self._run(r).select(*self.keys, "h")
                union = part if union is None else union.unionByName(part)
            level += 1
            runs = [r for r in runs if r not in same] + [self._write_run(union, f"{batch_id}-{level}", level)]
        self._write_manifest({"batch": batch_id, "runs": runs, "read": read, "keys": sum(r["n"] for r in before["runs"])})
        self._sweep(before, runs, batch_id)

    def _sweep(self, before: dict, runs: list[dict], batch_id: int) -> None:
        named = {r["name"] for r in [*before["runs"], *runs]}
        p, fs = self._fs("runs/*")
        old = [f.getPath().toString() for f in fs.globStatus(p) or [] if f.getPath().getName() not in named and int(f.getPath().getName().split("-")[0]) < batch_id]
        release(self.spark, [*old, f"{self.path}/maybe/{batch_id - 1}"])
