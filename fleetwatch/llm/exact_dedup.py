"""Exact deduplication by Grace hashing over complete contents.

1. Every task groups its own rows in an open-addressing table and hands on one row
   per distinct text (a stretch of bounded bytes at a time), so a text that makes up
   a third of the corpus leaves each task once, not once per copy.
2. These representatives are dealt out by content hash.  A task that gets more than
   fits its memory partitions them by further hash bits to spill files, and those
   again, until a bucket fits a table; equal hashes are settled by comparing the
   complete contents.
3. Every row finds its class by the number of its representative, which no class
   shares with another task, so that join is even.

Null text counts as empty.  Of equal texts the row with the largest id stays; a null
id is smaller than any other, and among rows with the same id the last row read
stays, so that exactly one row per distinct text is kept.  Repeated rows are copies;
an empty table gives an empty table; columns of any name are carried in one struct.  A text may
be as long as a row may be; a task holds a few of the longest ones.
"""
from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import ragged
from .common import _quoted, prepare

#: Bytes of rows that a task holds at once, in step 1 and in a bucket of step 2.
HELD_BYTES = 24 << 20
FANOUT_BITS = 4


class ContentTable:
    """Open addressing with linear probing; a slot holds the number of a content."""

    def __init__(self):
        self.slots, self.hashes, self.contents, self.held = [-1] * 1024, [], [], 0

    def number(self, h: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return k
            at = (at + 1) & mask
        k = self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.held += len(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return k

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def _contents(texts: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, one at a time."""
    for x in pc.fill_null(texts, "").cast(pa.large_string() if pa.types.is_large_string(texts.type) else pa.string()):
        yield x.as_buffer().to_pybytes()


def _rank(ids: list, rows: list[int]) -> list[tuple]:
    """Ascending order of preference of rows: null ids first, then by id, then by place."""
    return [(i is not None, i if i is not None else 0, r) for i, r in zip(ids, rows, strict=True)]


def _local(batches: Iterator[pa.RecordBatch], text: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (id, h, doc) to (row_id, id, class_id, n, h, doc): only the row that stays here for
    its text, which is field ``text`` of doc, keeps doc and n, the number of rows it stands for."""
    next_row, table = TaskContext.get().partitionId() << 33, ContentTable()
    held: list[tuple[pa.RecordBatch, list[int], list[int]]] = []  # batch, row numbers, classes
    best: list[tuple] = []
    count: list[int] = []

    def emptied() -> Iterator[pa.RecordBatch]:
        winner = [b[2] for b in best]
        for batch, rows, classes in held:
            owner = [winner[k] for k in classes]
            stays = pa.array([o == r for o, r in zip(owner, rows, strict=True)])
            n = pa.array([count[k] if o == r else 0 for k, o, r in zip(classes, owner, rows, strict=True)], pa.int64())
            kept = pa.array(np.where(stays.to_numpy(zero_copy_only=False), np.arange(len(rows)), -1))
            kept = pc.if_else(pc.less(kept, 0), pa.scalar(None, pa.int64()), kept)
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0), pa.array(owner), n, batch.column(1), batch.column(2).take(kept)], names)
        held.clear()
        best.clear()
        count.clear()
        ragged.give_back()

    size = 0
    for batch in batches:
        rows = list(range(next_row, next_row + batch.num_rows))
        next_row += batch.num_rows
        classes = []
        for h, content, rank in zip(batch.column(1).to_pylist(), _contents(batch.column(2).field(text)), _rank(batch.column(0).to_pylist(), rows), strict=True):
            k = table.number(h, content)
            classes.append(k)
            if k == len(best):
                best.append(rank)
                count.append(1)
            else:
                best[k] = max(best[k], rank)
                count[k] += 1
        held.append((batch, rows, classes))
        size += batch.nbytes
        if size >= HELD_BYTES:
            yield from emptied()
            size, table = 0, ContentTable()
    if held:
        yield from emptied()


class _Spill:
    """Files of one level, by the next bits of the hash."""

    def __init__(self, folder: str, level: int):
        self.folder, self.level, self.files = tempfile.mkdtemp(dir=folder), level, {}

    def add(self, batch: pa.RecordBatch) -> None:
        h = batch.column("h").to_numpy(zero_copy_only=False).astype(np.uint64)
        bucket = (h >> np.uint64(64 - FANOUT_BITS * (self.level + 1))) & np.uint64((1 << FANOUT_BITS) - 1)
        for b in np.unique(bucket).tolist():
            if b not in self.files:
                self.files[b] = pa.ipc.new_stream(os.path.join(self.folder, str(b)), batch.schema)
            self.files[b].write_batch(batch.take(pa.array(np.flatnonzero(bucket == b))))

    def buckets(self) -> Iterator[Iterator[pa.RecordBatch]]:
        for w in self.files.values():
            w.close()
        for b in sorted(self.files):
            path = os.path.join(self.folder, str(b))
            with pa.OSFile(path) as f:
                yield iter(pa.ipc.open_stream(f))
            os.remove(path)


def _settled(batches: Iterator[pa.RecordBatch], text: int, folder: str, level: int, keep: bool, names: list[str], limit: int) -> Iterator[pa.RecordBatch]:
    """One bucket: held in memory if it fits, else partitioned to files and taken one by one."""
    held, size, spill = [], 0, None
    last = FANOUT_BITS * (level + 1) > 64  # no hash bits left: only equal hashes remain
    for batch in batches:
        if spill is not None:
            spill.add(batch)
            continue
        held.append(batch)
        size += batch.nbytes
        if size > limit and not last:
            spill = _Spill(folder, level)
            for b in held:
                spill.add(b)
            held.clear()
    if spill is not None:
        for bucket in spill.buckets():
            yield from _settled(bucket, text, folder, level + 1, keep, names, limit)
        return
    table, best, count, classes = ContentTable(), [], [], []
    for batch in held:
        own = []
        rows = batch.column("row_id").to_pylist()
        for h, content, rank, n in zip(batch.column("h").to_pylist(), _contents(batch.column("doc").field(text)), _rank(batch.column("id").to_pylist(), rows), batch.column("n").to_pylist(), strict=True):
            k = table.number(h, content)
            own.append(k)
            if k == len(best):
                best.append(rank)
                count.append(n)
            else:
                best[k] = max(best[k], rank)
                count[k] += n
        classes.append(own)
    for batch, own in zip(held, classes, strict=True):
        rows = batch.column("row_id")
        stays = [best[k][2] for k in own]
        if keep:
            yield batch.select(["doc"]).filter(pc.equal(rows, pa.array(stays)))
        else:
            ids = pa.array([best[k][1] if best[k][0] else None for k in own], batch.schema.field("id").type)
            yield pa.RecordBatch.from_arrays([rows, pa.array(stays), ids, pa.array([count[k] for k in own]), batch.column("sha")], names)
    table, held, batch = None, None, None
    ragged.give_back()


def _grace(batches: Iterator[pa.RecordBatch], text: int, keep: bool, names: list[str], limit: int) -> Iterator[pa.RecordBatch]:
    # spill files live and die with the task, beside Spark's own spills
    local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    with tempfile.TemporaryDirectory(prefix="grace-", dir=local if local and os.path.isdir(local) else None) as folder:
        yield from _settled(batches, text, folder, 0, keep, names, limit)


def _representatives(df: DataFrame, id_column: str, text_column: str, keep: bool) -> DataFrame:
    """Step 1, written to the shared folder: its row numbers hold for everything after."""
    prepare(df.sparkSession)
    carried = df.columns if keep else [text_column]
    doc = F.struct(*[df[_quoted(c)] for c in carried])
    rows = df.select(df[_quoted(id_column)].alias("id"), F.xxhash64(F.coalesce(df[_quoted(text_column)], F.lit(""))).alias("h"), doc.alias("doc"))
    names, text = ["row_id", "id", "class_id", "n", "h", "doc"], carried.index(text_column)
    schema = _schema({"row_id": "long", "id": rows.schema["id"].dataType.simpleString(), "class_id": "long", "n": "long", "h": "long"}, rows, doc=True)
    return materialize(rows.mapInArrow(lambda b: _local(b, text, names), schema), "grace-representatives")


def _schema(fields: dict[str, str], rows: DataFrame, doc: bool):
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string
    out = StructType([StructField(k, _parse_datatype_string(v)) for k, v in fields.items()])
    return out.add(StructField("doc", rows.schema["doc"].dataType)) if doc else out


def classes(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: int = HELD_BYTES) -> DataFrame:
    """Per row: the id, keep_id, group_size, kept and text_sha256."""
    table = _representatives(df, id_column, text_column, keep=False)
    kind = table.schema["id"].dataType.simpleString()
    names = ["class_id", "keep_row", "keep_id", "group_size", "text_sha256"]
    text = F.coalesce(table["doc"][text_column], F.lit(""))
    reps = table.where("n > 0").select("row_id", "id", "n", "h", "doc", F.sha2(text, 256).alias("sha"))
    found = reps.repartition("h").mapInArrow(lambda b: _grace(b, 0, False, names, limit), f"class_id long, keep_row long, keep_id {kind}, group_size long, text_sha256 string")
    return table.select("row_id", "id", "class_id").join(found, "class_id").select(
        F.col("id").alias(id_column), "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256")


def deduplicate(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: int = HELD_BYTES) -> DataFrame:
    """The rows that stay, with all their columns."""
    table = _representatives(df, id_column, text_column, keep=True)
    reps, text = table.where("n > 0").select("row_id", "id", "n", "h", "doc"), df.columns.index(text_column)
    kept = reps.repartition("h").mapInArrow(lambda b: _grace(b, text, True, ["doc"], limit), _schema({}, reps, doc=True))
    return kept.select("doc.*")
