"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is a run of frames and
ends with a seek table in a skippable frame, which readers of plain Zstandard pass
over.  An index row maps each record identifier to its bundle, its frame, and its
offset and length in the unpacked frame, so one record costs one frame.  Bundles and
their index are written by Spark as binary rows of Parquet in the shared folder, which
any cluster store can hold; every bundle is bounded in size.

Of records with equal payloads (by SHA-256) of at least ``min_revisit`` bytes, that with
the smallest page id is a response with the payload and the others are revisits without;
a null id is larger than any other, and among rows with the same id the first by url
is the response.  Null payloads count as empty; null urls leave the header out; repeated
rows have a record each, with an identifier of its own; an empty table gives an empty table.  Only the named
columns are read, whatever the others' names; a payload may be as long as a row, and has a frame of its own then.
"""
from __future__ import annotations

import hashlib
import itertools
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .common import only, prepare

#: Unpacked bytes after which a frame is closed, and packed bytes after which a bundle is.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
#: Groups of equal payloads that may be broadcast; beyond that the same join is shuffled.
BROADCAST_ROWS = 500_000
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BundleWriter:
    """Frames, their seek table, and where each record lies."""

    def __init__(self):
        self.pack = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open, self.open_bytes = [], 0
        self.index: list[tuple[str, int, int, int]] = []
        self.bytes = 0

    def add(self, record_id: str, record: bytes) -> None:
        self.index.append((record_id, len(self.frames), self.open_bytes, len(record)))
        self.open.append(record)
        self.open_bytes += len(record)
        if self.open_bytes >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            frame = self.pack.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.open_bytes))
            self.bytes += len(frame)
            self.open, self.open_bytes = [], 0

    def finished(self) -> bytes:
        self._close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, packed bytes, unpacked bytes) of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    start = len(bundle) - 9 - n * width
    if struct.unpack("<II", bundle[start - 8: start]) != (SKIPPABLE_MAGIC, n * width + 9):
        raise ValueError("the seek table is damaged")
    out, at = [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", bundle, start + k * width)
        out.append((at, packed, plain))
        at += packed
    return out


def frame(bundle: bytes, place: tuple[int, int, int]) -> bytes:
    at, packed, plain = place
    return zstandard.ZstdDecompressor().decompress(bundle[at: at + packed], max_output_size=plain)


def record_id(kind: str, page_id: object, digest: str, nth: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}/{page_id}/{digest}/{nth}')}>"


def _header_value(text: str) -> str:
    """One line: control characters and blanks as a URL has them."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object | None, revisit: bool, nth: int = 0) -> tuple[str, bytes]:
    """The identifier and the bytes of a record."""
    name = record_id("revisit" if revisit else "response", page_id, digest, nth)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id('response', refers_to, digest)}", f"X-Payload-Length: {len(payload)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page: {refers_to}")
        block = b""
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and payload of the records of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at offset {at}")
        head = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
        size = int(head["content-length"])
        block = data[end + 4: end + 4 + size]
        if head["warc-type"] == "response":
            block = block[block.index(b"\r\n\r\n") + 4:]
        yield head, block
        at = end + 4 + size + 4


def _with_groups(df: DataFrame, id_column: str, url_column: str, payload_column: str, min_revisit: int) -> DataFrame:
    """id, url, payload, digest, first (the id of the response), revisit, nth."""
    rows = only(df, id=id_column, url=url_column, payload=payload_column).withColumn("payload", F.coalesce("payload", F.lit("")).cast("binary")) \
        .withColumn("digest", F.sha2("payload", 256))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    groups = rows.where(F.length("payload") >= min_revisit).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups.select("digest", "first"), "equal-payloads")
    small = groups.count() <= BROADCAST_ROWS
    marked = rows.join(F.broadcast(groups) if small else groups, "digest", "left")
    leads = (F.col("first.none") == F.col("id").isNull()) & F.col("first.id").eqNullSafe(F.col("id"))
    others = marked.where("first IS NULL OR NOT coalesce(first.none = (id IS NULL) AND first.id <=> id, false)").withColumn("nth", F.lit(1))
    # repeated ids at the head of a group: one of them is the response
    tied = marked.where(F.col("first").isNotNull() & leads).withColumn("nth", F.row_number().over(Window.partitionBy("digest").orderBy(F.col("url").asc_nulls_last())))
    return others.unionByName(tied).select("id", "url", "payload", "digest", F.col("first.id").alias("first"),
                                           (F.col("first").isNotNull() & ~(leads & (F.col("nth") == 1))).alias("revisit"))


def write(df: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", min_revisit: int = 100) -> DataFrame:
    """Bundles (bundle_id, data, records: the index) in the shared folder."""
    prepare(df.sparkSession)
    rows = _with_groups(df, id_column, url_column, payload_column, min_revisit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, number, base = BundleWriter(), 0, TaskContext.get().partitionId() << 32
        seen = 0

        def bundle() -> pa.RecordBatch:
            data = writer.finished()
            index = pa.array([[{"record_id": r, "frame": f, "offset": o, "length": n} for r, f, o, n in writer.index]], _INDEX)
            return pa.RecordBatch.from_arrays([pa.array([base + number]), pa.array([data], pa.binary()), index], ["bundle_id", "data", "records"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for row in batch.slice(k, 256).to_pylist():
                    seen += 1
                    # only responses that revisits may refer to have an identifier that follows from their id
                    own = row["revisit"] or len(row["payload"]) < min_revisit
                    writer.add(*record(row["id"], row["url"], row["payload"], row["digest"], row["first"], row["revisit"], base + seen if own else 0))
                    if writer.bytes >= BUNDLE_BYTES:
                        yield bundle()
                        writer, number = BundleWriter(), number + 1
        if writer.index:
            yield bundle()

    schema = "bundle_id long, data binary, records array<struct<record_id:string,frame:int,offset:long,length:long>>"
    return materialize(rows.mapInArrow(run, schema), "warc-bundles")


_INDEX = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))


def record_index(bundles: DataFrame) -> DataFrame:
    """record_id, bundle_id, frame, offset, length: one row per record."""
    return bundles.select("bundle_id", F.explode("records").alias("r")).select("r.record_id", "bundle_id", "r.frame", "r.offset", "r.length")


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """(record_id, record) of the rows of ``wanted`` (record_id, bundle_id, frame, offset,
    length, as in the index), unpacking only the frames they lie in."""
    asked = wanted.groupBy("bundle_id").agg(F.sort_array(F.collect_list(F.struct("frame", "record_id", "offset", "length"))).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a bundle at a time, which goes there once
                row = batch.slice(k, 1).to_pylist()[0]
                places = seek_table(row["data"])
                for number, some in itertools.groupby(row["asked"], key=lambda a: a["frame"]):
                    plain, some = frame(row["data"], places[number]), list(some)
                    yield pa.RecordBatch.from_arrays([pa.array([a["record_id"] for a in some], pa.string()), pa.array([plain[a["offset"]: a["offset"] + a["length"]] for a in some], pa.binary())], ["record_id", "record"])

    return asked.join(bundles.select("bundle_id", "data"), "bundle_id").mapInArrow(run, "record_id string, record binary")


def read(bundles: DataFrame) -> DataFrame:
    """Per record: record_id, page_id and refers_to as text, url, record_type, payload_bytes and
    payload_digest of the full payload, and the payload (null for revisits).  A response
    whose payload doesn't match its digest ends the job."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                bundle = data.as_py()
                for place in seek_table(bundle):
                    yield _table(list(parse(frame(bundle, place))))

    return bundles.select("data").mapInArrow(run, "record_id string, page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")


def _table(records: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
    columns: dict[str, list] = {k: [] for k in ("record_id", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")}
    for head, payload in records:
        revisit, digest = head["warc-type"] == "revisit", head["warc-payload-digest"].removeprefix("sha256:")
        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{head['warc-record-id']}: the payload doesn't match its digest")
        for k, v in (("record_id", head["warc-record-id"]), ("page_id", head.get("x-page-id")), ("url", head.get("warc-target-uri")), ("record_type", head["warc-type"]),
                     ("refers_to", head.get("x-refers-to-page")), ("payload_bytes", int(head["x-payload-length"]) if revisit else len(payload)),
                     ("payload_digest", digest), ("payload", None if revisit else payload)):
            columns[k].append(v)
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.string())) for k, v in columns.items()], list(columns))
