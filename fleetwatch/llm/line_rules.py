"""Quality rules with cross-document line frequency.

One pass over the texts gives each document's base counts and the hashes of its
normalised lines (A-Z lower-cased, digits alike, white space between words as one
blank); it is written to the shared folder.  Lines are then counted per host over
distinct texts, so that copies of one text count once.  A line is boilerplate and is
removed if it is in more than ``max_share`` of its host's texts (and in at least ``FEW``), or, as
``LONG`` words and more do not repeat by chance, if it has as many and is in more than
``min_docs`` texts, however large the host.  A document of which less than ``keep_share``
of its words is left is depleted and rejected, as is one that fails the base rules.  Near
copies are distinct texts: the long lines shared by more than ``min_docs`` of them go.

Null and empty texts have no words and fail the base rules.  A null host is a host of
its own.  Repeated rows get the same verdict each; an empty table gives an empty
table; columns of any name are carried in one struct.  A text is worked on whole, however long: a task needs some fifty times its bytes for it.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from ..session import materialize
from . import ragged
from .common import _quoted, prepare

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
#: Texts that a line must be in to be boilerplate of a small host.
FEW = 3
#: Words of a line that is boilerplate by its number of texts alone.
LONG = 8
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
#: Bytes as they count for a normalised line.
_NORMAL = ragged.LOWER.copy()
_NORMAL[ord("0"): ord("9") + 1] = ord("0")


class Counted:
    """Base counts of a batch of texts, and its lines that have a word."""

    def __init__(self, texts: pa.Array):
        buf, offs = ragged.flat(texts)
        n = self.texts = len(texts)
        starts, ends, docs = ragged.words(buf, offs)
        word = ragged.span_hashes(buf, starts, ends)
        self.n_words = np.bincount(docs, minlength=n)

        def within(flag: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flag)])
            return total[offs[1:]] - total[offs[:-1]]

        self.word_chars = within(~ragged.IS_SPACE[buf] & ((buf & 0xC0) != 0x80))
        self.n_symbols = within(_SYMBOL[buf])
        self.n_repeat_words = self._repeated(word, docs)

        breaks = np.flatnonzero(buf == 0x0A)
        line = np.searchsorted(breaks, starts) + docs
        first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(line)][: len(first)]
        self.line_doc, self.line_words = docs[first], last - first
        after = np.searchsorted(breaks, starts[first])
        edges = np.r_[-1, breaks, len(buf)]
        self.line_start = np.maximum(edges[after] + 1, offs[self.line_doc])
        self.line_end = np.minimum(edges[after + 1], offs[self.line_doc + 1])
        raw = ragged.span_hashes(buf, self.line_start, self.line_end) ^ ragged.mix(self.line_doc.astype(np.uint64))
        _, seen = np.unique(raw, return_index=True)
        new = np.zeros(len(raw), bool)
        new[seen] = True
        self.n_dup_lines = np.bincount(self.line_doc, weights=~new, minlength=n).astype(np.int64)
        self.line_hash = ragged.span_hashes(ragged.span_hashes(_NORMAL[buf], starts, ends), first, last)
        before = np.cumsum(self.n_words) - self.n_words
        self.whole = ragged.span_hashes(word, before, before + self.n_words)
        self.offs = offs

    def _repeated(self, word: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Words in windows that are found twice or more in their text."""
        at = np.arange(max(0, len(word) - WINDOW + 1))
        at = at[docs[at] == docs[at + WINDOW - 1]] if len(at) else at
        keys = ragged.span_hashes(word, at, at + WINDOW) ^ ragged.mix(docs[at].astype(np.uint64))
        _, back, often = np.unique(keys, return_inverse=True, return_counts=True)
        covered = np.zeros(len(word), bool)
        for k in range(WINDOW):
            covered[at[often[back] > 1] + k] = True
        return np.bincount(docs, weights=covered, minlength=self.texts).astype(np.int64)

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)

    def lists(self, values: np.ndarray) -> pa.Array:
        edges = np.searchsorted(self.line_doc, np.arange(self.texts + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(edges), pa.array(values))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _counted(df: DataFrame, id_column: str, text_column: str, host_column: str, carry: bool) -> DataFrame:
    """The pass over the texts: row_id, id, host, counts, base_failed, whole, lines, line_words, doc."""
    prepare(df.sparkSession)
    columns = df.columns if carry else [text_column]
    doc = F.struct(*[df[_quoted(c)].alias(f"c{k}") for k, c in enumerate(columns)])
    rows = df.select(df[_quoted(id_column)].alias("id"), df[_quoted(host_column)].cast("string").alias("host"), doc.alias("doc"))
    text = columns.index(text_column)
    names = ["row_id", "id", "host", *_COUNTS, "base_failed", "whole", "lines", "line_words"] + ["doc"] * carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_row = TaskContext.get().partitionId() << 33
        for batch in batches:
            whole = pa.RecordBatch.from_arrays([*batch.columns, batch.column(2).field(text)], ["id", "host", "doc", "text"])
            for part in ragged.slices(whole, 3):
                c = Counted(part.column(3))
                yield pa.RecordBatch.from_arrays([
                    pa.array(next_row + np.arange(part.num_rows)), part.column(0), part.column(1), *(pa.array(getattr(c, k)) for k in _COUNTS),
                    pa.array(c.base_failed), pa.array(c.whole.view(np.int64)), c.lists(c.line_hash.view(np.int64)), c.lists(c.line_words)] + [part.column(2)] * carry, names)
                next_row += part.num_rows

    schema = StructType().add("row_id", LongType()).add("id", rows.schema["id"].dataType).add("host", "string")
    for k in _COUNTS:
        schema = schema.add(k, LongType())
    schema = schema.add("base_failed", "boolean").add("whole", LongType()).add("lines", ArrayType(LongType())).add("line_words", ArrayType(LongType()))
    return materialize(rows.mapInArrow(run, schema.add("doc", rows.schema["doc"].dataType) if carry else schema), "line-counts")


def _boilerplate(counted: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """(row_id, removed_words, removed: hashes) of rows that have a line above the limits."""
    host = F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host")
    texts = counted.select(*host, "whole").distinct().groupBy("host", "no_host").agg(F.count("*").alias("texts"))
    each = counted.select(*host, "whole", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
    per_text = each.select("host", "no_host", "whole", F.col("l.lines").alias("line"), (F.col("l.line_words") >= LONG).alias("long")).distinct()
    often = per_text.groupBy("host", "no_host", "line", "long").agg(F.count("*").alias("n")).where(F.col("n") >= FEW)
    above = (F.col("n") > F.lit(max_share) * F.col("texts")) | (F.col("long") & (F.col("n") > min_docs))
    limits = often.join(texts, ["host", "no_host"]).where(above).select("host", "no_host", "line")
    limits = materialize(limits, "frequent-lines")
    lines = counted.select("row_id", *host, F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("row_id", "host", "no_host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    hit = lines.join(limits, ["host", "no_host", "line"])
    return hit.groupBy("row_id").agg(F.sum("words").alias("removed_words"), F.count("*").alias("removed_lines"), F.collect_set("line").alias("removed"))


def _judged(counted: DataFrame, min_docs: int, max_share: float, keep_share: float) -> DataFrame:
    found = counted.join(_boilerplate(counted, min_docs, max_share), "row_id", "left")
    found = found.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("removed_words", "removed_lines")})
    left = F.col("n_words") - F.col("removed_words")
    return found.withColumn("kept", ~F.col("base_failed") & (left >= F.lit(keep_share) * F.col("n_words")))


def judge(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
          min_docs: int = 20, max_share: float = 0.08, keep_share: float = 0.5) -> DataFrame:
    """Per row: the id, the base counts, base_failed, kept, removed_words and removed_lines."""
    found = _judged(_counted(df, id_column, text_column, host_column, carry=False), min_docs, max_share, keep_share)
    return found.select(F.col("id").alias(id_column), *_COUNTS, "base_failed", "kept", "removed_words", "removed_lines")


def clean(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
          min_docs: int = 20, max_share: float = 0.08, keep_share: float = 0.5) -> DataFrame:
    """The rows that are kept, with all their columns, their texts without boilerplate lines."""
    found = _judged(_counted(df, id_column, text_column, host_column, carry=True), min_docs, max_share, keep_share).where("kept")
    at, names = df.columns.index(text_column), [f"c{k}" for k in range(len(df.columns))]
    rows = found.select("doc", "removed")
    kind = rows.schema["doc"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.RecordBatch.from_arrays([*batch.columns, batch.column(0).field(at)], ["doc", "removed", "text"])
            for part in ragged.slices(whole, 2):
                texts = without_lines(part.column(2), part.column(1).to_pylist())
                fields = part.column(0).flatten()
                fields[at] = texts
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, names)], ["doc"])

    out = rows.mapInArrow(run, StructType().add("doc", kind))
    return out.select(*[F.col(f"doc.c{k}").alias(c) for k, c in enumerate(df.columns)])


def without_lines(texts: pa.Array, removed: list[list[int] | None]) -> pa.Array:
    """The texts without the lines of these hashes, and without the line breaks after them."""
    c = Counted(texts)
    out = texts.to_pylist()
    edges = np.searchsorted(c.line_doc, np.arange(c.texts + 1))
    for d, hashes in enumerate(removed):
        if not hashes:
            continue
        gone = np.isin(c.line_hash.view(np.int64)[edges[d]: edges[d + 1]], np.array(hashes, np.int64))
        raw, kept, at = out[d].encode("utf-8"), [], 0
        for k in np.flatnonzero(gone) + edges[d]:
            a, b = int(c.line_start[k] - c.offs[d]), int(c.line_end[k] - c.offs[d])
            kept.append(raw[at:a])
            at = min(len(raw), b + 1)
        out[d] = b"".join([*kept, raw[at:]]).decode("utf-8")
    return pa.array(out, texts.type)
