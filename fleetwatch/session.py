"""Spark session and shared-folder helpers."""
from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: HotSpot compiles no method of more bytecode than this.  Spark's own limit lets longer ones through,
#: which are then interpreted for every row.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit", "8000"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Lists of paths that are being recorded, innermost last.
_RECORDERS: ContextVar[tuple[list[str], ...]] = ContextVar("recorders", default=())
_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


def get_spark(master: str | None = None, app: str = "fleetwatch",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a folder that driver and executors share
    (HDFS, object store) and is used as is; without it the call fails, because a
    machine-local folder would be written by one machine and missed by the next.
    Only a local master, where there is one machine, gets a fresh folder."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set; master {master} needs a folder that all machines share")
        d = tempfile.mkdtemp(prefix="fleetwatch-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def keep_compiled(spark: SparkSession) -> None:
    """Wide projections and aggregates run as compiled expressions instead of one method that is
    too long to be compiled; a setting of the caller's own stays."""
    name, limit = METHOD_LIMIT
    if spark.conf.get(name, "65535") == "65535":
        spark.conf.set(name, limit)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per Spark application.

    Functions that run on executors are pickled by reference to their module, so
    workers need the package on their path wherever the job was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    d = tempfile.TemporaryDirectory()  # the driver serves it for as long as it runs
    archive = os.path.join(d.name, f"fleetwatch-{app}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    f = os.path.join(folder, n)
                    z.write(f, os.path.relpath(f, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED[app] = d


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries inside the block delete their shuffle files when they end; else these stay on disk until the
    driver collects the plans as garbage, which may take longer than the whole job."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df, name: str, large: bool = False):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` but computes the plan only once (an
    eager RDD checkpoint runs it a second time to write it).  The folder is on
    the cluster's shared storage, so the table survives executor loss.  ``large`` is for tables
    of all rows and features: they are packed more tightly, and what their job has shuffled is deleted."""
    import uuid
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    if large:
        with shuffles_dropped(df.sparkSession):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    for paths in _RECORDERS.get():
        paths.append(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that ``materialize`` writes inside the block."""
    paths: list[str] = []
    token = _RECORDERS.set((*_RECORDERS.get(), paths))
    try:
        yield paths
    finally:
        _RECORDERS.reset(token)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing will read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
