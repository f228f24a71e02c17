"""Product quantisation of vectors to short codes, with whole-number codebooks.

Components become ``floor(256 x)``; vectors are cut into equal parts, and each part is
replaced by the number of the nearest entry of its position's codebook (the lower number of
equally near ones), found exactly in a GNAT (see ``gnat``).  Codebooks begin as the parts of the
vectors with the smallest ids; a round assigns all parts and replaces each entry that was
used by the componentwise ``floor(sum / count)`` of its parts.

A round is one pass over the table: tasks return their sums by entry and component, which Spark
adds up; only the codebooks (parts x entries x width numbers, whatever the table's size)
come to the driver and go to the tasks.  Sums travel in limbs, so they are exact for
components of any size; distances are exact in doubles up to components of some ten
million and in Python's whole numbers beyond.

Rows whose vector is null or has null or non-finite components are left out.  Shorter vectors
count as filled up with zeros to the longest one's length and to a multiple of the number of
parts.  Null ids come last; rows with equal ids are ordered by vector and all count; fewer
rows than entries make smaller codebooks; an empty table gives an empty table.  Errors
beyond a long are the largest long.  Only the named columns are read, whatever the others' names.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import materialize
from .common import only, prepare
from .gnat import Gnat

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Bits of a limb of a sum.
LIMB = 40
_LONGEST = (1 << 63) - 1
#: Components beyond this are handled as Python's whole numbers.
_WIDE = 2.0 ** 52 / SCALE


def _kept(df: DataFrame, vector: str, **columns: str) -> DataFrame:
    """The named columns and ``vector`` as doubles, of the rows whose vectors are whole."""
    rows = only(df, **columns, vector=vector).withColumn("vector", F.col("vector").cast("array<double>"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vector").isNotNull() & sound)


def _floors(values: np.ndarray) -> np.ndarray:
    """floor(256 x), exact for every finite double."""
    if len(values) == 0 or np.abs(values).max() < _WIDE:
        return np.floor(values * SCALE).astype(np.int64)
    return np.array([int(x) * SCALE if abs(x) >= _WIDE else int(np.floor(x * SCALE)) for x in values.tolist()], object)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Whole-number rows of ``width`` components."""
    flat = _floors(vectors.flatten().to_numpy(zero_copy_only=False))
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), flat.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Codebooks:
    """Entries by part: ``books[part]`` is [entries, width of a part] whole numbers."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books
        self.width = sum(b.shape[1] for b in books)

    def digest(self) -> str:
        """SHA-256 of all components as decimals, by part, entry and position."""
        return hashlib.sha256(",".join(str(int(x)) for b in self.books for x in b.ravel()).encode()).hexdigest()

    def nearest(self, trees: list[Gnat], rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By part: the rows' components, entry and squared distance."""
        step = self.books[0].shape[1]
        for p, tree in enumerate(trees):
            mine = rows[:, p * step: (p + 1) * step]
            yield mine, *tree.nearest(mine)

    def trees(self) -> list[Gnat]:
        return [Gnat(b) for b in self.books]


def _whole(values: list[int], shape: tuple[int, ...]) -> np.ndarray:
    return np.array(values, np.int64 if all(abs(v) < 1 << 52 for v in values) else object).reshape(shape)


def _together(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``rows`` rows (but for the last): a walk through the trees costs as much for a few."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _sums(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    """One task's sums and counts by slot, in signed limbs of 40 bits."""
    trees, n, step = books.trees(), len(books.books[0]), books.books[0].shape[1]
    total = np.zeros((len(trees), n, step + 1), object)
    for batch in _together(batches):
        rows = _matrix(batch.column("vector"), books.width)
        for p, (mine, index, _) in enumerate(books.nearest(trees, rows)):
            part = np.zeros((n, step + 1), mine.dtype)
            np.add.at(part, index, np.concatenate([mine, np.ones((len(mine), 1), mine.dtype)], axis=1))
            total[p] += part.astype(object)
    out = []
    for slot, value in enumerate(total.ravel().tolist()):
        limb, sign, value = 0, (1 if value > 0 else -1), abs(value)
        while value:
            out.append((slot, limb, sign * (value & ((1 << LIMB) - 1))))
            value, limb = value >> LIMB, limb + 1
    if out:
        slots, limbs, totals = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(limbs, pa.int32()), pa.array(totals, pa.int64())], ["slot", "limb", "total"])


def learn(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` rounds over the whole table."""
    prepare(df.sparkSession)
    rows = _kept(df, vector_column, id=id_column)
    seeds = [r.vector for r in rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()]
    if not seeds:
        return Codebooks([np.zeros((0, 1), np.int64)] * parts)
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    step = max(1, -(-longest // parts))
    first = _matrix(pa.array(seeds, pa.list_(pa.float64())), parts * step)
    books = Codebooks([_whole(first[:, p * step: (p + 1) * step].ravel().tolist(), (len(seeds), step)) for p in range(parts)])
    for _ in range(rounds):
        tasks = rows.select("vector").mapInArrow(lambda b, books=books: _sums(b, books), "slot long, limb int, total long")
        slots = [0] * (parts * len(seeds) * (step + 1))
        # parts x entries x (width + 1) sums, however many rows there are
        for r in tasks.groupBy("slot", "limb").agg(F.sum("total").alias("total")).collect():
            slots[r.slot] += r.total << (LIMB * r.limb)
        sums = np.array(slots, object).reshape(parts, len(seeds), step + 1)
        after = []
        for p, book in enumerate(books.books):
            new = [[s // c for s in row] if c else old for row, c, old in zip(sums[p, :, :step].tolist(), sums[p, :, step].tolist(), book.tolist(), strict=True)]
            after.append(_whole([x for row in new for x in row], (len(seeds), step)))
        books = Codebooks(after)
    return books


def _coded(batches: Iterator[pa.RecordBatch], books: Codebooks, names: list[str]) -> Iterator[pa.RecordBatch]:
    trees = books.trees()
    for batch in _together(batches):
        rows = _matrix(batch.column("vector"), books.width)
        codes, error = np.zeros((len(rows), len(trees)), np.uint8), np.zeros(len(rows), object)
        for p, (_, index, distance) in enumerate(books.nearest(trees, rows)):
            codes[:, p] = index
            error += distance.astype(np.int64).astype(object) if distance.dtype != object else distance
        text, size = codes.tobytes().hex(), 2 * len(trees)
        code = pa.array([text[k * size: (k + 1) * size] for k in range(len(rows))], pa.string())
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], code, pa.array([min(int(x), _LONGEST) for x in error], pa.int64())], [*names, "code", "error"])


def encode(df: DataFrame, books: Codebooks, vector_column: str = "embedding", **columns: str) -> DataFrame:
    """The columns named by ``columns`` with code and error (the summed squared distances)."""
    rows = _kept(df, vector_column, **columns)
    names = list(columns)
    fields = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(lambda b: _coded(b, books, names), f"{fields}, code string, error long")


def decode(coded: DataFrame, books: Codebooks, code_column: str = "code") -> DataFrame:
    """``coded`` with the vector that each code stands for, as ``decoded``."""
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(code_column).to_pylist()
            out = [None if t is None else [float(x) / SCALE for p, b in enumerate(books.books) for x in b[int(t[2 * p: 2 * p + 2], 16)]] for t in text]
            yield batch.append_column("decoded", pa.array(out, pa.list_(pa.float64())))
    return coded.mapInArrow(told, StructType([*coded.schema.fields, StructField("decoded", ArrayType(DoubleType()))]))


def errors_by_label(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> tuple[DataFrame, Codebooks]:
    """Per kept row: id, code, error and label_error, the error of all rows of its label (null: a label, too)."""
    books = learn(df, id_column, vector_column)
    coded = materialize(encode(df, books, vector_column, id=id_column, label=label_column), "codes")
    total = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    total = total.select(F.col("label").alias("of"), F.least("total", F.lit(_LONGEST)).cast("long").alias("label_error"))
    # Spark broadcasts the totals where they are small; else skewed labels are split at run time
    found = coded.join(total, F.col("label").eqNullSafe(F.col("of")))
    return found.select(F.col("id").alias(id_column), "code", "error", "label_error"), books
