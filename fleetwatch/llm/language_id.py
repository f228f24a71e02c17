"""Language identification with bit-sliced Bloom filters over character n-grams.

Training counts the n-grams of a bounded sample of labelled texts per language on
Spark.  An n-gram belongs to every language in which its share is at least a fixed
part of its largest share.  All languages share one filter of ``positions`` rows; a
row is a bitmask of languages, so the AND of an n-gram's rows is the set of all
languages that contain it.  A text's n-grams are looked up once per distinct word of
a batch; the hits of each language are counted, freed of the false positives that
the filling of its bit slice leads to expect, and the largest count decides.

Null texts, empty texts and texts without a letter are ``und`` with score 0, and so is
every text if nothing could be learned (an empty table, no labels).  Ties go to the
language with more training texts, then to the first by name.  Rows with a null label
are not learned from, but predicted; repeated rows are predicted each.  Rows with a null id are all in
the sample or all out of it, as it is drawn by id.  Columns that a prediction carries may have any
name.  A text is worked on whole, however long: a task needs some fifty times its bytes for it.
"""
from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize, recorded, release
from . import ragged
from .common import _quoted, only, prepare

SIZES = (3, 4, 5)
HASHES = 3
#: Positions of the filter that are put together in one group.
BLOCK = 1 << 14
UNKNOWN = "und"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case if it is (part of) a letter, else 0; and
    whether it is a letter by itself."""
    lower, letter = np.zeros(sys.maxunicode + 1, np.uint32), np.zeros(sys.maxunicode + 1, bool)
    for c in range(0x20000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            small = chr(c).lower()
            lower[c] = ord(small) if len(small) == 1 else c
            letter[c] = kind == "L"
    for c in range(0x20000, 0x32000):
        if unicodedata.category(chr(c)) == "Lo":
            lower[c], letter[c] = c, True
    return lower, letter


_TABLES: list = []


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES.extend(_tables())
    return _TABLES[0], _TABLES[1]


@dataclass
class DistinctWords:
    """The words of a batch of texts, each distinct one once, and its n-grams."""
    back: np.ndarray      #: distinct word of each word
    docs: np.ndarray      #: document of each word
    grams: np.ndarray     #: hashes of the n-grams of the distinct words
    owner: np.ndarray     #: distinct word of each n-gram
    letters: np.ndarray   #: whether a distinct word has a letter


def distinct_words(texts: pa.Array) -> DistinctWords:
    buf, offs = ragged.flat(texts)
    buf = ragged.LOWER[buf]
    starts, ends, docs = ragged.words(buf, offs)
    keys, first, back = np.unique(ragged.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    size = ends[first] - starts[first]
    # the distinct words, a blank before each and one at the end
    spaced = np.full(int(size.sum()) + len(first) + 1, 0x20, np.uint8)
    inner = np.ones(len(spaced), bool)
    inner[np.cumsum(size + 1) - size - 1] = False
    inner[-1] = False
    spaced[inner] = buf[ragged.ranges(starts[first], size)]
    codes = np.frombuffer(spaced.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    word = np.cumsum(codes == 0x20) - 1
    lower, letter = letter_tables()
    has = np.zeros(len(first) + 1, bool)
    has[word[letter[codes]]] = True
    low = lower[codes]
    blank = low == 0
    before = np.concatenate([[0], np.cumsum(blank)])
    grams, owner = [], []
    for n in SIZES:
        at = np.arange(max(0, len(low) - n + 1))
        at = at[before[at + n - 1] == before[at + 1]]  # blanks at most at the two ends
        grams.append(ragged.span_hashes(low, at, at + n))
        owner.append(word[at + 1])
    return DistinctWords(back, docs, np.concatenate(grams), np.concatenate(owner), has[:-1])


@dataclass
class Filters:
    languages: list[str]
    masks: np.ndarray        #: positions x words of 64 languages
    chance: np.ndarray       #: false-positive rate of each language

    def positions(self, grams: np.ndarray) -> np.ndarray:
        return _positions(grams, len(self.masks))

    def sets(self, grams: np.ndarray) -> np.ndarray:
        """The bitmask of all languages that may contain each n-gram."""
        out = np.full((len(grams), self.masks.shape[1]), ~np.uint64(0))
        for p in self.positions(grams):
            out &= self.masks[p]
        return out

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language (-1: unknown) and score of each text."""
        n, k = len(texts), len(self.languages)
        w = distinct_words(texts)
        if k == 0 or len(w.back) == 0:
            return np.full(n, -1), np.zeros(n)
        per = np.zeros((len(w.letters), k + 1), np.int64)
        step = 1 << 18
        order = np.argsort(w.owner, kind="stable")
        owner = w.owner[order]
        for a in range(0, len(order), step):  # bounded temporary arrays
            found, own = self.sets(w.grams[order[a: a + step]]), owner[a: a + step]
            edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for c in range(k):
                bit = (found[:, c // 64] >> np.uint64(c % 64) & np.uint64(1)).astype(np.int64)
                per[own[edge], c] += np.add.reduceat(bit, edge)
            per[own[edge], k] += np.diff(np.r_[edge, len(own)])
        counts = np.stack([ragged.sums(per[w.back, c], w.docs, n) for c in range(k + 1)], axis=1)
        letters = ragged.sums(w.letters[w.back], w.docs, n) > 0
        grams = counts[:, k:]
        corrected = np.clip((counts[:, :k] - grams * self.chance) / (1 - self.chance), 0, None)
        best = corrected.argmax(axis=1)
        score = np.where(grams[:, 0] > 0, corrected[np.arange(n), best] / np.maximum(grams[:, 0], 1), 0.0)
        return np.where(letters, best, -1), np.where(letters, np.clip(score, 0, 1), 0.0)


def _positions(grams: np.ndarray, rows: int) -> list[np.ndarray]:
    a, b = grams & np.uint64(0xFFFFFFFF), grams >> np.uint64(32) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(rows)).astype(np.int64) for i in range(HASHES)]


def learn(train: DataFrame, text_column: str = "text", label_column: str = "lang", id_column: str = "doc_id",
          sample: int = 2000, share: float = 0.2, positions: int = 1 << 20) -> Filters:
    """Filters from about ``sample`` texts per language (all, where there are fewer): the rows
    whose hashed id falls below the fraction that gives so many.  What reaches the driver
    is the filter, whose size its parameters fix, and a count per language."""
    prepare(train.sparkSession)
    rows = only(train, id=id_column, text=text_column, lang=label_column).where("lang IS NOT NULL AND text IS NOT NULL").withColumn("lang", F.col("lang").cast("string"))
    sizes = sorted(((r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect()), key=lambda x: (-x[1], x[0]))
    names = [name for name, _ in sizes]
    masks = np.zeros((positions, max(1, -(-len(names) // 64))), np.uint64)
    if not names:
        return Filters([], masks, np.zeros(0))
    fraction = F.create_map(*[F.lit(x) for name, n in sizes for x in (name, min(1.0, sample / n))])
    number = F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, k)])
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.where(draw < fraction[F.col("lang")]).select(number[F.col("lang")].alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, 1):
                lang = part.column(0).to_numpy(zero_copy_only=False)
                for k in np.unique(lang).tolist():
                    w = distinct_words(part.column(1).filter(pa.array(lang == k)))
                    often = np.bincount(w.back, minlength=len(w.letters))
                    grams, back = np.unique(w.grams, return_inverse=True)
                    n = np.bincount(back, weights=often[w.owner], minlength=len(grams)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), k, np.int32)), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    spark = train.sparkSession
    with recorded() as tables:
        counts = materialize(chosen.mapInArrow(count, "lang int, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "gram-counts")
        for k, block in _blocks(counts, len(names), share, positions):
            masks[k: k + len(block)] = block
    release(spark, tables)
    filled = np.array([np.count_nonzero(masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(len(names))]) / positions
    return Filters(names, masks, filled ** HASHES)


def _blocks(counts: DataFrame, languages: int, share: float, positions: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first position, masks from there) of the filter's blocks in use.  The masks are joined on the
    executors, so what the driver gets is the filter, whatever the number and length of the texts."""
    width = -(-languages // 64)
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return
    total = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, float(n))])
    rates = counts.select("gram", "lang", (F.col("n") / total[F.col("lang")]).alias("rate"))
    own = rates.groupBy("gram").agg(F.collect_list(F.struct("lang", "rate")).alias("own"), F.max("rate").alias("top"))  # an entry per language at most
    belongs = own.select("gram", "top", F.explode("own").alias("x")).where(F.col("x.rate") >= F.lit(share) * F.col("top")).select("gram", "x.lang")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(1).to_numpy(zero_copy_only=False)
            bit = np.uint64(1) << (lang % 64).astype(np.uint64)
            for p in _positions(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), positions):
                yield pa.RecordBatch.from_arrays([pa.array(p * width + lang // 64), pa.array(bit.view(np.int64))], ["at", "mask"])

    def block(table: pa.Table) -> pa.Table:
        at, mask = table["at"].to_numpy(), table["mask"].to_numpy().view(np.uint64)
        first = at[0] // (BLOCK * width) * BLOCK
        masks = np.zeros(min(BLOCK, positions - first) * width, np.uint64)
        masks[at - first * width] = mask
        return pa.table({"first": pa.array([first], pa.int64()), "masks": pa.array([masks.tobytes()], pa.binary())})

    cells = belongs.mapInArrow(place, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask"))
    for r in cells.groupBy(F.floor(F.col("at") / F.lit(BLOCK * width))).applyInArrow(block, "first long, masks binary").collect():
        yield r["first"], np.frombuffer(r["masks"], np.uint64).reshape(-1, width)


def keep_known(df: DataFrame, filters: Filters, text_column: str = "text", min_score: float = 0.3) -> DataFrame:
    """The rows of ``df`` whose language is known with at least ``min_score``; one narrow pass.
    Where nothing could be learned, no language can be told from another, and all rows whose
    text has a letter are kept."""
    prepare(df.sparkSession)
    rows = df.select(df[_quoted(text_column)].alias("text"), F.struct(*[df[_quoted(c)] for c in df.columns]).alias("doc"))
    if not filters.languages:
        return rows.mapInArrow(_with_letters, rows.select("doc").schema).select("doc.*")
    found = _predicted(df.sparkSession, rows, filters)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= min_score)).select("doc.*")


def _with_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in ragged.slices(batch, 0, 1 << 20):
            w = distinct_words(part.column(0))
            letters = ragged.sums(w.letters[w.back], w.docs, part.num_rows) > 0
            yield part.select(["doc"]).filter(pa.array(letters))


def predictions(df: DataFrame, filters: Filters, text_column: str, **columns: Column) -> DataFrame:
    """The given columns, lang_pred and lang_score per row."""
    prepare(df.sparkSession)
    return _predicted(df.sparkSession, df.select(df[_quoted(text_column)].alias("text"), F.struct(*[c.alias(n) for n, c in columns.items()]).alias("doc")), filters).select("doc.*", "lang_pred", "lang_score")


def _predicted(spark, rows: DataFrame, filters: Filters) -> DataFrame:
    """``text`` and ``doc`` to ``doc``, lang_pred, lang_score.  The filters are broadcast: their
    size is fixed by their parameters."""
    shared = spark.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(shared.value.languages + [UNKNOWN], object)
        for batch in batches:
            for part in ragged.slices(batch, 0, 1 << 20):
                best, score = shared.value.predict(part.column(0))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(names[best], pa.string()), pa.array(score)], ["doc", "lang_pred", "lang_score"])

    from pyspark.sql.types import DoubleType, StringType, StructType
    schema = StructType().add("doc", rows.schema["doc"].dataType).add("lang_pred", StringType()).add("lang_score", DoubleType())
    return rows.mapInArrow(run, schema)
