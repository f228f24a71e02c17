"""A message topic on shared storage: partitions, offsets, and readers that keep their place.

A topic is a folder with a folder per partition; a partition is a row of segments, Arrow files
named after the offsets of their first message and of the one behind their last.  A message
has a key and a value; its partition follows from the key, so the messages of a key stay in
the order in which they were published.

``df.write.format("topic")`` publishes (key, value).  Tasks write segments under ``_staging``; only
when all are done the driver gives them their offsets and moves them to their place, so a
job that fails leaves no message behind, and readers see whole segments only.
``spark.readStream.format("topic")`` reads (partition, offset, key, value): from the earliest or the latest
offsets at first (``startingOffsets``), then from where the query's checkpoint says, so a
restarted query loses and repeats nothing.  With ``group``, what has been processed is also noted under
``_groups`` for others to see, as soon as Spark says so: when the next micro-batch begins.  ``spark.read.format("topic")`` reads what is there.

The storage is any that Arrow's file systems reach by the path's scheme (none: local and
mounted folders).
"""
from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship_package

FORMAT = "topic"
PARTITIONS = 4
#: Messages that a task of a reader takes at least before another one is used for the rest.
SPLIT = 100_000
READ = "partition int, offset long, key string, value string"
_SEGMENT = pa.schema([("key", pa.string()), ("value", pa.string())])


def _storage(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


@dataclass(frozen=True)
class Segment:
    partition: int
    first: int
    end: int
    path: str


class Log:
    """The segments of a topic."""

    def __init__(self, path: str):
        self.fs, self.root = _storage(path.rstrip("/"))

    def partitions(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        return sorted(int(f.base_name.split("=")[1]) for f in found if f.base_name.startswith("partition="))

    def segments(self, partition: int) -> list[Segment]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/partition={partition}", allow_not_found=True))
        marks = [(*map(int, f.base_name.removesuffix(".arrow").split("-")), f.path) for f in found if f.base_name.endswith(".arrow")]
        return [Segment(partition, a, b, p) for a, b, p in sorted(marks)]

    def ends(self) -> dict[str, int]:
        """The offset behind the last message of every partition."""
        return {str(p): max([0, *(s.end for s in self.segments(p))]) for p in self.partitions()}

    def between(self, start: dict[str, int], end: dict[str, int], split: int = SPLIT) -> list[list[tuple[Segment, int, int]]]:
        """Stretches of segments from ``start`` up to ``end``: one list of a partition's neighbours each."""
        out = []
        for p, last in end.items():
            held, n = [], 0
            for s in self.segments(int(p)):
                a, b = max(s.first, start.get(p, 0)), min(s.end, last)
                if a < b:
                    held.append((s, a, b))
                    n += b - a
                if n >= split:
                    out.append(held)
                    held, n = [], 0
            if held:
                out.append(held)
        return out

    def read(self, stretch: list[tuple[Segment, int, int]]) -> Iterator[pa.RecordBatch]:
        for s, a, b in stretch:
            with self.fs.open_input_file(s.path) as f:
                at = s.first
                reader = pa.ipc.open_file(f)
                for k in range(reader.num_record_batches):
                    batch = reader.get_batch(k)
                    lo, hi = max(a - at, 0), min(b - at, batch.num_rows)
                    if lo < hi:
                        part = batch.slice(lo, hi - lo)
                        n = part.num_rows
                        yield pa.RecordBatch.from_arrays([pa.array([s.partition] * n, pa.int32()), pa.array(range(at + lo, at + hi), pa.int64()), part.column(0), part.column(1)],
                                                         ["partition", "offset", "key", "value"])
                    at += batch.num_rows


class _Stretch(InputPartition):
    def __init__(self, parts: list[tuple[Segment, int, int]]):
        self.parts = parts


class _Published(WriterCommitMessage):
    def __init__(self, staged: list[tuple[int, int, str]]):
        self.staged = staged


class _Writer(DataSourceWriter):
    """Rows (partition, key, value); every task writes a segment for each partition it meets."""

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator) -> WriterCommitMessage:
        log, files, counts, held = Log(self.path), {}, {}, {}
        base = f"{log.root}/_staging/{self.job}"
        log.fs.create_dir(base, recursive=True)

        def flush(p: int) -> None:
            if p not in files:
                name = f"{base}/{p}-{uuid.uuid4().hex}.arrow"
                files[p] = (pa.ipc.new_file(log.fs.open_output_stream(name), _SEGMENT), name)
            keys, values = zip(*held.pop(p), strict=True)
            files[p][0].write_batch(pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], schema=_SEGMENT))
            counts[p] = counts.get(p, 0) + len(keys)

        for row in iterator:
            held.setdefault(row.partition, []).append((row.key, row.value))
            if len(held[row.partition]) >= 10_000:
                flush(row.partition)
        for p in list(held):
            flush(p)
        for w, _ in files.values():
            w.close()
        return _Published([(p, counts[p], name) for p, (_, name) in files.items()])

    def commit(self, messages) -> None:
        log = Log(self.path)
        ends = log.ends()
        for p, n, name in [s for m in messages if m is not None for s in m.staged]:  # in the order of the tasks
            folder, first = f"{log.root}/partition={p}", ends.get(str(p), 0)
            log.fs.create_dir(folder, recursive=True)
            log.fs.move(name, f"{folder}/{first:020d}-{first + n:020d}.arrow")
            ends[str(p)] = first + n
        self._sweep(log)

    def abort(self, messages) -> None:
        self._sweep(Log(self.path))

    def _sweep(self, log: Log) -> None:
        staged = f"{log.root}/_staging/{self.job}"
        if log.fs.get_file_info(staged).type != pafs.FileType.NotFound:
            log.fs.delete_dir(staged)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        log = Log(self.path)
        return [_Stretch(s) for s in log.between({}, log.ends())] or [_Stretch([])]

    def read(self, partition):
        yield from Log(self.path).read(partition.parts)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, options: dict):
        self.path, self.group = path, options.get("group")
        self.latest_first = options.get("startingoffsets", options.get("startingOffsets", "earliest")) == "latest"

    def initialOffset(self) -> dict:
        ends = Log(self.path).ends()
        return ends if self.latest_first else {p: 0 for p in ends}

    def latestOffset(self) -> dict:
        return Log(self.path).ends()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Stretch(s) for s in Log(self.path).between(start, end)]

    def read(self, partition):
        yield from Log(self.path).read(partition.parts)

    def commit(self, end: dict) -> None:
        if self.group:
            log = Log(self.path)
            log.fs.create_dir(f"{log.root}/_groups", recursive=True)
            with log.fs.open_output_stream(f"{log.root}/_groups/{self.group}") as f:
                f.write(json.dumps(end).encode())


class TopicSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """The format by its name.  Spark plans a source in a process of its own that gets no files of the
    application, so the source goes there by value, not as a module to be imported."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    ship_package(spark)
    spark.dataSource.register(TopicSource)


def publish(df: DataFrame, path: str, order: list[str], partitions: int = PARTITIONS) -> None:
    """Append ``df`` (key, value, order columns): every key's messages go to one partition, in ``order``."""
    register(df.sparkSession)
    placed = df.withColumn("partition", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"))
    rows = placed.repartition("partition").sortWithinPartitions("partition", *order)
    rows.select("partition", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")) \
        .write.format(FORMAT).option("path", path).mode("append").save()


def stream(spark: SparkSession, path: str, starting: str = "earliest", group: str | None = None) -> DataFrame:
    register(spark)
    reader = spark.readStream.format(FORMAT).option("path", path).option("startingOffsets", starting)
    return (reader.option("group", group) if group else reader).load()


def committed(path: str, group: str) -> dict[int, int]:
    """The offsets up to which a group has processed a topic."""
    log = Log(path)
    with log.fs.open_input_file(f"{log.root}/_groups/{group}") as f:
        return {int(p): n for p, n in json.loads(f.read()).items()}
