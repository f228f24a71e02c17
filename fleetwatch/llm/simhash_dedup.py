"""Near-duplicate components by 64-bit SimHash fingerprints and BK-trees.

Texts are lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+`` and those into shingles of four
words joined by one space, repeats included; a text of one to three words is one shingle.  A
bit of the fingerprint is 1 if it is set in over half of the shingles' XXH64 (seed 42).
Fingerprints link at up to ``RADIUS`` differing bits; a component is what links reach.

1. Equal fingerprints are one from the start, so copies cost nothing more.
2. Two fingerprints that differ in up to four bits agree in all but four of any m blocks of
   bits.  Each fingerprint goes to one bucket for every choice of m - 4 blocks, and m grows
   with the number of fingerprints (5 blocks up to some 260 thousand, 6 to 70 million, 7 to
   9 billion, then 8), so that buckets stay at some 64 unrelated fingerprints.  Only members of a
   bucket meet, in a BK-tree (see ``bk_trees``) whose edges within the radius are followed.
3. A bucket of more than ``SHARD`` fingerprints (variants of one text) is dealt out to shards,
   each a tree of bounded size.  A first round queries each shard's tree with its own members
   and with those of the bucket's first shard, which ties the shards of one cluster together.
   The second sends every fingerprint outside the bucket's largest component to all its
   shard trees, which are sent to as many tasks as there are blocks of such queries.  A link
   that the second round passes over has both ends in one component already, so none is lost.
4. A task hands on links to the smallest fingerprint of each local component only, so the
   links are fewer than the fingerprints, however dense a group is.

Null, empty and blank texts have fingerprint zero, linked like any other.  Texts may have any
length: shingles are counted in blocks.  Repeated rows are copies and all come out; a
null id counts for no component id (a component with null ids only has a null one); an empty table gives an
empty table; columns other than the two named ones aren't read, whatever their names.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import ragged
from .bk_trees import Forest, joined
from .common import only, prepare
from .components import components

WORDS = 4
SEED = 42
RADIUS = 4
#: Fingerprints of a shard tree, and of unrelated ones in a bucket.
SHARD = 4096
BUCKET = 64
#: Fingerprints that a task holds at once: whole buckets, as many as fit.
HELD = 1 << 16
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def _prints(texts: pa.Array) -> np.ndarray:
    """Fingerprints (uint64) of a batch of texts."""
    buf, offs = ragged.flat(texts)
    starts, ends, docs = ragged.words(buf, offs)
    n = np.bincount(docs, minlength=len(texts))
    # words of the batch with one blank behind each
    size = ends - starts + 1
    at = np.cumsum(size) - size
    plain = np.full(int(size.sum()), 0x20, np.uint8)
    plain[ragged.ranges(at, size - 1)] = ragged.LOWER[buf[ragged.ranges(starts, size - 1)]]
    first = np.cumsum(n) - n
    shingles = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    begin = ragged.ranges(first, shingles)
    doc = np.repeat(np.arange(len(texts)), shingles)
    last = begin + np.minimum(n, WORDS)[doc] - 1
    raw, digest = plain.tobytes(), xxhash.xxh64_intdigest
    counts = np.zeros((len(texts), 64), np.int64)
    for a in range(0, len(begin), BLOCK):
        b = slice(a, a + BLOCK)
        left, right = at[begin[b]].tolist(), (at[last[b]] + size[last[b]] - 1).tolist()
        h = np.array([digest(raw[x:y], SEED) for x, y in zip(left, right, strict=True)], np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        seam = np.flatnonzero(np.diff(doc[b], prepend=-1))
        counts[doc[b][seam]] += np.add.reduceat(bits, seam, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > shingles[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in ragged.slices(whole, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_prints(batch.column("text")).view(np.int64))], ["id", "print"])


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id and print, the fingerprint's bits as a signed long."""
    prepare(df.sparkSession)
    rows = only(df, id=id_column, text=text_column)
    return rows.mapInArrow(_printed, f"id {rows.schema['id'].dataType.simpleString()}, print long")


def _blocks(n: int, radius: int) -> list[int]:
    """Masks of the bits that define a bucket, one for every table."""
    for m in range(radius + 1, radius + 5):
        cuts = [64 * k // m for k in range(m + 1)]
        masks = [sum((1 << cuts[k + 1]) - (1 << cuts[k]) for k in chosen) for chosen in combinations(range(m), m - radius)]
        if n <= BUCKET << min(mask.bit_count() for mask in masks):
            break
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, print, visitor), sorted by bucket with visitors last, to links (a, b).

    Trees hold the members of whole buckets; members and visitors query them.  The visitors
    of a bucket that doesn't fit at once come in blocks behind its members."""
    def answered(bucket: list, prints: np.ndarray, visitor: np.ndarray) -> Iterator[pa.RecordBatch]:
        member = ~visitor
        name = np.cumsum(np.concatenate([[0], (bucket[1:] != bucket[:-1])])) if len(bucket) else np.zeros(0, np.int64)
        # a bucket of visitors only has no tree
        own = np.unique(name[member])
        at = np.searchsorted(own, name)
        known = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == name) if len(own) else np.zeros(len(name), bool)
        forest = Forest(prints[member], at[member])
        place = np.flatnonzero(member)
        asked = np.flatnonzero(known)
        label = np.arange(len(prints))
        for q, found in forest.within(prints[asked], at[asked], radius):
            # one round of joining for each block, so a dense group's pairs are never kept
            a, b = label[asked[q]], label[place[found]]
            label = joined(a, b, len(label))[label]
        least = np.full(len(prints), np.iinfo(np.int64).max)
        signed = prints.view(np.int64)
        np.minimum.at(least, label, signed)
        low = least[label]
        some = low < signed
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(low[some]), pa.array(signed[some])], ["a", "b"])

    held_b, held_p, held_v = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    for batch in batches:
        b = batch.column("bucket").to_numpy()
        held_b = np.concatenate([held_b, b])
        held_p = np.concatenate([held_p, batch.column("print").to_numpy().view(np.uint64)])
        held_v = np.concatenate([held_v, batch.column("visitor").to_numpy(zero_copy_only=False)])
        if len(held_b) < HELD:
            continue
        open_from = int(np.flatnonzero(np.diff(held_b, prepend=held_b[0] - 1))[-1])  # the last bucket may go on
        if open_from:
            yield from answered(held_b[:open_from], held_p[:open_from], held_v[:open_from])
            held_b, held_p, held_v = held_b[open_from:], held_p[open_from:], held_v[open_from:]
        elif held_v.any():  # its members are all here: the visitors so far are answered
            yield from answered(held_b, held_p, held_v)
            held_b, held_p, held_v = held_b[~held_v], held_p[~held_v], held_v[~held_v]
    yield from answered(held_b, held_p, held_v)


def _met(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links among ``rows`` (keys, print, visitor) that agree in ``keys``."""
    # groups are told apart by a 64-bit hash of their keys; two of the same hash would only be compared needlessly
    named = rows.select(F.xxhash64(*keys).alias("bucket"), "print", "visitor")
    return named.repartition("bucket").sortWithinPartitions("bucket", "visitor").mapInArrow(lambda b: _links(b, radius), "a long, b long")


def linked(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``prints`` (distinct print) to (print, label): the smallest print (signed) of its component, for those with links."""
    masks = _blocks(prints.count(), radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("print").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for t, m in enumerate(masks)])
    rows = prints.select("print", F.explode(tables).alias("b")).select("b.t", "b.key", "print")
    large = materialize(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > shard), "large-buckets")
    if large.isEmpty():
        links = materialize(_met(rows.withColumn("visitor", F.lit(False)), ["t", "key"], radius), "print-links")
        return components(links)
    small = rows.join(large, ["t", "key"], "left_anti").withColumn("visitor", F.lit(False))
    shards = F.ceil(F.col("n") / shard).cast("int")
    dealt = rows.join(large, ["t", "key"]).select("t", "key", "print", shards.alias("shards"), F.pmod(F.xxhash64("print"), shards).cast("int").alias("shard"))
    dealt = materialize(dealt, "dealt-prints")
    own = dealt.select("t", "key", "shard", "print", F.lit(False).alias("visitor"))
    hubs = dealt.where("shard = 0").select("t", "key", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "print").where("shard > 0").withColumn("visitor", F.lit(True))
    first = materialize(_met(small, ["t", "key"], radius).unionByName(_met(own.unionByName(hubs), ["t", "key", "shard"], radius)), "print-links")
    labels = components(first).withColumnRenamed("node", "print")

    found = dealt.join(labels, "print", "left").withColumn("label", F.coalesce("label", "print"))
    found = materialize(found, "labelled-prints")
    of_label = found.groupBy("t", "key", "label").agg(F.count("*").alias("n"))
    largest = of_label.groupBy("t", "key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("others"))
    open_ = materialize(largest.where("others > 0").withColumn("blocks", F.ceil(F.col("others") / (4 * shard)).cast("int")), "open-buckets")
    if open_.isEmpty():
        return labels.select(F.col("print").alias("node"), "label")
    rest = found.join(open_, ["t", "key"])
    all_shards, all_blocks = F.sequence(F.lit(0), F.col("shards") - 1), F.sequence(F.lit(0), F.col("blocks") - 1)
    asking = rest.where("label <> main").select("t", "key", F.explode(all_shards).alias("shard"), F.pmod(F.xxhash64("print", F.lit(1)), F.col("blocks")).cast("int").alias("block"), "print", F.lit(True).alias("visitor"))
    trees = rest.select("t", "key", "shard", F.explode(all_blocks).alias("block"), "print", F.lit(False).alias("visitor"))
    second = materialize(_met(trees.unionByName(asking), ["t", "key", "shard", "block"], radius), "print-links")
    return components(first.unionByName(second))


def classes(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per row: the id, fingerprint (16 hex digits) and component_id (the smallest id of its component)."""
    rows = materialize(fingerprints(df, id_column, text_column), "fingerprints")
    reps = materialize(rows.groupBy("print").agg(F.min("id").alias("first")), "distinct-prints")
    labels = linked(reps.select("print"), radius)
    found = reps.join(labels.select(F.col("node").alias("print"), "label"), "print", "left").withColumn("label", F.coalesce("label", "print"))
    least = found.groupBy("label").agg(F.min("first").alias("component_id"))
    of_print = materialize(found.select("print", "label").join(least, "label").select("print", "component_id"), "print-components")
    # a print may belong to a third of all rows: Spark broadcasts the other side where it is small, else splits the skewed part
    return rows.join(of_print, "print").select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
