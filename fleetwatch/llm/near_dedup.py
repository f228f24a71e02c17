"""Near-duplicate classes by Order MinHash and banded alignment.

The k-mers are shingles of five words, labelled with their occurrence (the first,
second, ... time that the shingle stands in the text).  A sketch takes the three
labelled shingles with the smallest keyed hashes and hashes them in text order; each
text has twenty such sketches.  Texts that agree in a sketch are candidates.

The similarity is that of the two shingle sequences under insertions and deletions,
in Jaccard form: ``m / (a + b - m)`` with ``m`` labelled shingles matched in order.  At a
similarity of 0.8 no alignment leaves a diagonal band of ``(a + b) / 9``, so
matches outside it are cut away, and the longest chain inside it gives ``m``.

Work stays linear in a group of copies: equal texts are one text from the start; then
every bucket of equal sketches is compared with one hub only, and what is alike is joined.  Buckets that still hold several classes are settled exactly: their
texts are joined on the rarest fifth of their shingles, one of which two similar texts
must share (frequent ones together with a band of lengths that the text can be similar to), and pairs whose parity bits differ in too many places are passed over; so no
link between different texts is lost to the shortcut, and texts that have but a passage
in common, or are edited too far from each other, don't meet.  (At a similarity of 0.8 all but one pair in a
million agree in some sketch.)

Words are ``[^\\x20\\x09-\\x0D]+`` as they stand.  A text of one to four words has itself as its
only shingle; null, empty and blank texts have no words and are one class.  Repeated
rows are copies; an empty table gives an empty table; columns of any name are
carried in one struct.  A text is worked on whole, however long: a task needs some fifty times its bytes for it.
"""
from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from ..session import materialize, recorded, release
from . import ragged
from .common import _quoted, prepare
from .components import components

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 20
MINIMA = 3
PARITY_BITS = 1024
#: Rows of 8 bytes that may be broadcast; beyond that the same join is shuffled.
BROADCAST_ROWS = 2_000_000
#: Texts that share a shingle beyond which they are looked up by bands of length, and the width of a band.
CROWDED, BAND = 32, 1.05
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _keys(n: int) -> tuple[np.ndarray, np.ndarray]:
    k = ragged.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return k[:n], k[n:] | np.uint64(1)


class Shingled:
    """The labelled shingles of a batch of texts, one text after the other."""

    def __init__(self, texts: pa.Array):
        buf, offs = ragged.flat(texts)
        starts, ends, docs = ragged.words(buf, offs)
        word = ragged.span_hashes(buf, starts, ends)
        self.texts = len(texts)
        self.words = np.bincount(docs, minlength=self.texts)
        first = np.cumsum(self.words) - self.words
        #: Shingles of each text and the place of its first.
        self.n = np.where(self.words >= WORDS, self.words - WORDS + 1, np.minimum(self.words, 1))
        self.at = np.cumsum(self.n) - self.n
        self.doc = np.repeat(np.arange(self.texts), self.n)
        begin = ragged.ranges(first, self.n)
        width = np.minimum(self.words, WORDS)[self.doc]
        plain = ragged.span_hashes(word, begin, begin + width)
        # two independent hashes of the whole word sequence tell texts apart
        self.whole = ragged.span_hashes(word, first, first + self.words)
        self.check = ragged.span_hashes(ragged.mix(word + np.uint64(0x51ED270B)), first, first + self.words)
        self.labelled = self._label(plain)

    def _label(self, plain: np.ndarray) -> np.ndarray:
        own = plain ^ ragged.mix(self.doc.astype(np.uint64) + np.uint64(1))
        order = np.argsort(own, kind="stable")
        same = np.r_[False, own[order][1:] == own[order][:-1]]
        place = np.arange(len(own))
        since = place - np.maximum.accumulate(np.where(same, 0, place))
        occurrence = np.empty(len(own), np.uint64)
        occurrence[order] = since.astype(np.uint64)
        return np.where(occurrence > 0, ragged.mix(plain + occurrence * np.uint64(0x9E3779B97F4A7C15)), plain)

    def parity(self) -> np.ndarray:
        """texts x PARITY_BITS / 64: a bit for each residue of the shingles' hashes, set if an odd
        number of shingles has it."""
        at = self.doc * PARITY_BITS + (self.labelled % np.uint64(PARITY_BITS)).astype(np.int64)
        odd = np.bincount(at, minlength=self.texts * PARITY_BITS).astype(np.uint8) & 1
        return np.packbits(odd, bitorder="little").view("<i8").reshape(self.texts, -1)

    def sketches(self) -> np.ndarray:
        """texts x SKETCHES; texts without words have zeros."""
        out = np.zeros((self.texts, SKETCHES), np.uint64)
        full = np.flatnonzero(self.n)
        if len(full) == 0:
            return out
        starts, size = self.at[full], self.n[full]
        owner = np.repeat(np.arange(len(full)), size)
        for j, (a, b) in enumerate(zip(*_keys(SKETCHES), strict=True)):
            x = (self.labelled ^ a) * b
            x ^= x >> np.uint64(29)
            places = np.full((len(full), MINIMA), len(x), np.int64)
            for k in range(MINIMA):
                low = np.minimum.reduceat(x, starts)
                hit = np.flatnonzero((x == low[owner]) & (x != _LAST))
                places[owner[hit], k] = hit
                x[hit] = _LAST
            places.sort(axis=1)  # text order
            there = places < len(x)
            taken = np.where(there, self.labelled[np.where(there, places, 0)], np.uint64(0))
            h = np.full(len(full), np.uint64(j + 1))
            for k in range(MINIMA):
                h = ragged.mix(h * np.uint64(0x100000001B3) + taken[:, k])
            out[full, j] = h
        return out


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Similarity of each pair of texts, exact from SIMILARITY on (below it, a lower bound)."""
    a, b = Shingled(left), Shingled(right)
    total = a.n + b.n
    pair = ragged.mix(np.arange(len(left), dtype=np.uint64) + np.uint64(7))
    _, i, j = np.intersect1d(a.labelled ^ pair[a.doc], b.labelled ^ pair[b.doc], return_indices=True)
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    doc = a.doc[i]
    i, j = i - a.at[doc], j - b.at[doc]
    # m >= s / (1 + s) * total leaves (1 - s) / (1 + s) * total insertions and deletions
    inside = np.abs(i - j) <= np.ceil(total * ((1 - SIMILARITY) / (1 + SIMILARITY)))[doc]
    doc, j = doc[inside], j[inside]
    m = np.bincount(doc, minlength=len(left))
    edge = np.searchsorted(doc, np.arange(len(left) + 1))
    falls = np.flatnonzero((doc[1:] == doc[:-1]) & (j[1:] < j[:-1]))
    for d in np.unique(doc[falls]).tolist():
        if m[d] >= SIMILARITY / (1 + SIMILARITY) * total[d]:
            m[d] = _chain(j[edge[d]: edge[d + 1]].tolist())
    both_empty = total == 0
    return np.where(both_empty, 1.0, m / np.maximum(total - m, 1))


def _chain(places: list[int]) -> int:
    """Length of the longest rising chain."""
    tails: list[int] = []
    for p in places:
        k = bisect_left(tails, p)
        if k == len(tails):
            tails.append(p)
        else:
            tails[k] = p
    return len(tails)


def _sketched(df: DataFrame, id_column: str, text_column: str, carry: bool) -> DataFrame:
    """(row_id, id, fa, fb, n, sketches, doc) in the shared folder; ``doc`` holds the columns of
    ``df`` as c0, c1, ... if they are carried, else the text alone as c0."""
    prepare(df.sparkSession)
    columns = df.columns if carry else [text_column]
    doc = F.struct(*[df[_quoted(c)].alias(f"c{k}") for k, c in enumerate(columns)])
    rows = df.select(df[_quoted(id_column)].alias("id"), doc.alias("doc"))
    text = columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_row = TaskContext.get().partitionId() << 33
        for batch in batches:
            whole = pa.RecordBatch.from_arrays([*batch.columns, batch.column(1).field(text)], ["id", "doc", "text"])
            for part in ragged.slices(whole, 2):
                s = Shingled(part.column(2))
                sketches = pa.FixedSizeListArray.from_arrays(pa.array(s.sketches().view(np.int64).ravel()), SKETCHES).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(next_row + np.arange(part.num_rows)), part.column(0), pa.array(s.whole.view(np.int64)), pa.array(s.check.view(np.int64)),
                    pa.array(s.n), sketches, part.column(1)], ["row_id", "id", "fa", "fb", "n", "sketches", "doc"])
                next_row += part.num_rows

    schema = StructType().add("row_id", LongType()).add("id", rows.schema["id"].dataType)
    for name in ("fa", "fb", "n"):
        schema = schema.add(name, LongType())
    schema = schema.add("sketches", ArrayType(LongType())).add("doc", rows.schema["doc"].dataType)
    return materialize(rows.mapInArrow(run, schema), "sketched")


def _checked(df: DataFrame) -> DataFrame:
    """Broadcast a written table of row numbers if it is small, else leave it to shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose texts are as similar as asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, 2):
                ok = similarities(part.column(2), part.column(3)) >= SIMILARITY - 1e-12
                yield part.select(["a", "b"]).filter(pa.array(ok))

    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a") \
        .join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return materialize(both.mapInArrow(run, "a long, b long"), "verified")


def _alike_in_length(a: str, b: str) -> F.Column:
    return F.least(a, b) >= F.lit(SIMILARITY) * F.greatest(a, b)


def _prefixes(open_texts: DataFrame, texts: DataFrame) -> DataFrame:
    """The shingles by which texts meet, (rep, n, label, known, parity, often, s), by prefix filtering.

    Texts at the similarity share all but a fifth of their shingles, so with the shingles of
    every text in one order, two such texts share one of the first fifth of each.  The order
    is by rarity: shingles that no other text has come first and lead to no pair, those of a
    passage that many texts share come last.  A shingle of one class alone leads to no pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, 3):
                s = Shingled(part.column(3))
                edges = np.concatenate([s.at, [len(s.labelled)]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(s.labelled.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], lists, pa.array(list(s.parity()), pa.list_(pa.int64()))], ["rep", "n", "label", "shingles", "parity"])

    read = open_texts.join(texts, "rep").select("rep", "n", "label", "text").mapInArrow(run, "rep long, n long, label long, shingles array<long>, parity array<long>")
    read = materialize(read, "open-shingles")
    rows = read.select("rep", "n", "label", F.explode("shingles").alias("s"))
    mixed = (F.min("label") < F.max("label")).cast("long")
    shared = rows.groupBy("s").agg((2 * F.count("*") + mixed).alias("often")).where("often > 3")  # twice the number of texts, and whether of several classes
    own = rows.join(shared, "s").groupBy("rep", "n", "label").agg(F.sort_array(F.collect_list(F.struct("often", "s"))).alias("by_rarity"))
    alone = F.col("n") - F.size("by_rarity")
    own = own.withColumn("known", F.size("by_rarity"))
    first = F.col("n") - F.ceil(F.lit(SIMILARITY - 1e-12) * F.col("n")) + 1 - alone
    prefix = own.where(first > 0).withColumn("first", first.cast("int")).join(read.select("rep", "parity"), "rep")
    met = prefix.select("rep", "n", "label", "known", "parity", F.explode(F.expr("slice(by_rarity, 1, first)")).alias("x")).where("x.often % 2 = 1")
    return materialize(met.select("rep", "n", "label", "known", "parity", F.floor(F.col("x.often") / 2).alias("often"), "x.s"), "prefixes")


def _band(n: F.Column) -> F.Column:
    return F.floor(F.log(n) / math.log(BAND)) + 1


def _sides(prefix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prefixes as the shorter and the longer text of a pair, to be joined by ``s`` and ``band``.

    A pair of n_a and n_b shingles must share 4/9 of n_a + n_b, so a text of which others know only so
    many has partners of 0.8 n to 9/4 known - n shingles.  Under a shingle that many texts have, those
    are looked up by bands of length: texts of one template that are too unlike each other don't meet."""
    crowded = F.col("often") > CROWDED
    short = prefix.withColumn("band", F.when(crowded, _band(F.col("n"))).otherwise(F.lit(0)))
    low = SIMILARITY * F.col("n") - 1e-6
    high = F.least(F.col("n"), F.col("known") * ((1 + SIMILARITY) / SIMILARITY) - F.col("n") + 1e-6)
    bands = F.when(crowded, F.when(high >= low, F.sequence(_band(low), _band(high))).otherwise(F.array().cast("array<bigint>"))).otherwise(F.array(F.lit(0).cast("long")))
    long = prefix.withColumn("band", F.explode(bands))
    a, b = (side.select("s", "band", *[F.col(c).alias(f"{c}_{name}") for c in ("rep", "n", "label", "known", "parity")]) for side, name in ((short, "a"), (long, "b")))
    return a, b


def _open_pairs(open_texts: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts in different classes that may be similar."""
    x, y = _sides(_prefixes(open_texts, texts))
    total = F.col("n_a") + F.col("n_b")
    # both must have enough shingles that some other text has, too, for what the pair must share;
    # parities differ in no more places than there are shingles that only one of the two has
    enough = F.least("known_a", "known_b") >= F.lit(SIMILARITY / (1 + SIMILARITY) - 1e-12) * total
    apart = sum((F.bit_count(F.col("parity_a")[k].bitwiseXOR(F.col("parity_b")[k])) for k in range(PARITY_BITS // 64)), F.lit(0))
    near = apart <= F.lit((1 - SIMILARITY) / (1 + SIMILARITY) + 1e-12) * total
    ordered = F.struct("n_a", "rep_a") < F.struct("n_b", "rep_b")
    met = x.join(y, ["s", "band"]).where(ordered & (F.col("label_a") != F.col("label_b")) & _alike_in_length("n_a", "n_b") & enough & near)
    return met.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def _classes(sketched: DataFrame, text_field: str) -> DataFrame:
    """(fa, fb, rep, label): each distinct text, its smallest row and that of its class."""
    reps = materialize(sketched.groupBy("fa", "fb").agg(F.min("row_id").alias("rep"), F.first("n").alias("n"), F.first("sketches").alias("sketches")), "texts")
    buckets = reps.where("n > 0").select("rep", "n", F.posexplode("sketches").alias("j", "v"))
    sizes = buckets.groupBy("j", "v").agg(F.count("*").alias("members")).where("members > 1")
    shared = materialize(buckets.join(sizes, ["j", "v"]), "shared-buckets")
    # the hub of a bucket is the member that meets the most others in all its buckets: in a group
    # of edited copies, the text that they are copies of rather than one of them
    meets = shared.groupBy("rep").agg(F.sum("members").alias("meets"))
    ranked = shared.join(meets, "rep")
    hubs = ranked.groupBy("j", "v").agg(F.max(F.struct("meets", (-F.col("rep")).alias("first"), "rep", "n")).alias("hub"))
    near_hub = shared.join(hubs, ["j", "v"]).where(F.col("rep") != F.col("hub.rep")).where(_alike_in_length("n", "hub.n")) \
        .select(F.least("hub.rep", "rep").alias("a"), F.greatest("hub.rep", "rep").alias("b")).distinct()
    tried = materialize(near_hub, "hub-pairs")

    # texts of all that share a bucket, also of those that only meet in the second round
    needed = materialize(shared.select("rep").distinct(), "candidates")
    texts = materialize(sketched.select(F.col("row_id").alias("rep"), F.col(f"doc.{text_field}").alias("text")).join(_checked(needed), "rep"), "candidate-texts")
    links = _verified(tried, texts)
    first = components(links)

    labelled = shared.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n", "j", "v", F.coalesce("label", "rep").alias("label"))
    split = materialize(labelled.groupBy("j", "v").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("j", "v"), "open-buckets")
    open_texts = labelled.join(split, ["j", "v"]).select("rep", "n", "label").distinct()
    pairs = _open_pairs(materialize(open_texts, "open-texts"), texts).join(tried, ["a", "b"], "left_anti")
    more = _verified(materialize(pairs, "cross-pairs"), texts)
    labels = first if more.isEmpty() else components(links.union(more))
    return reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("fa", "fb", "rep", F.coalesce("label", "rep").alias("label"))


def _written_classes(sketched: DataFrame, text_field: str) -> DataFrame:
    """The classes in the shared folder, without the tables that led to them."""
    with recorded() as tables:
        found = materialize(_classes(sketched, text_field), "classes")
    release(sketched.sparkSession, tables[:-1])
    return found


def classes(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, class_id (a number shared by all rows of a class and no other) and
    class_size."""
    sketched = _sketched(df, id_column, text_column, carry=False)
    found = _written_classes(sketched, "c0")
    # counted by text first: a class of many texts meets its size once a text, and both sides of that join
    # are written tables, so Spark splits the part of a class with very many
    rows_of = sketched.groupBy("fa", "fb").agg(F.count("*").alias("n_rows"))
    texts = materialize(found.select("fa", "fb", "label").join(rows_of, ["fa", "fb"]), "text-sizes")
    sizes = materialize(texts.groupBy("label").agg(F.sum("n_rows").alias("class_size")), "class-sizes")
    sized = materialize(texts.join(sizes, "label").select("fa", "fb", F.col("label").alias("class_id"), "class_size"), "sized-texts")
    return sketched.select("id", "fa", "fb").join(sized, ["fa", "fb"]).select(F.col("id").alias(id_column), "class_id", "class_size")


def deduplicate(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each class, with all its columns: that with the largest id (null ids are
    smallest; of equal ids the last row)."""
    sketched = _sketched(df, id_column, text_column, carry=True)
    found = _written_classes(sketched, f"c{df.columns.index(text_column)}")
    rows = sketched.select("row_id", "id", "fa", "fb").join(found.select("fa", "fb", "label"), ["fa", "fb"])
    stays = rows.groupBy("label").agg(F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "row_id")).alias("best")).select(F.col("best.row_id").alias("row_id"))
    gone = materialize(rows.select("row_id").join(stays, "row_id", "left_anti"), "near-copies")
    kept = sketched.select("row_id", "doc").join(_checked(gone), "row_id", "left_anti")
    return kept.select(*[F.col(f"doc.c{k}").alias(c) for k, c in enumerate(df.columns)])
