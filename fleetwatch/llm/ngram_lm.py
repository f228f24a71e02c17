"""Scores of texts under a smoothed bigram model, held in Elias-Fano tries by shard.

Nothing that grows with the corpus is gathered in one place.  Texts are turned into
chunks of some million tokens, written to the shared folder; a chunk's distinct words and
distinct bigrams go to shards by hash, each once per chunk however often they stand in it:

1. Word shards add up the training counts of all chunks and answer each chunk.
2. Bigram shards add up the bigram counts, build a trie in memory-mapped files and
   score the chunks' bigrams with it; they give each chunk one sum per document.  A
   context with so many tokens that it would weigh down a shard is dealt out by its
   successors as well.
3. The sums of a chunk's documents are added.

The trie has a level of contexts and one of their successors.  Contexts, the successors'
vocabulary and the pointers from a context to its successors are Elias-Fano sequences;
a successor is stored relative to its context (``context number * vocabulary + word``),
which makes the level monotone, and is found by a successor search in its context's
range.  Its smoothed probability is a 16-bit logarithm, and so is the weight of a
context for the words that it was never followed by.

Model: ``p(w) = (c(w) - d) / N`` for known words, the rest of the mass for all unknown words
together, with ``d = n1 / (n1 + 2 n2)``; ``p(w | v) = (c(v, w) + m p(w)) / (c(v) + m)``.  A text
starts with its own context and ends with a token that is counted as any other.

Null and empty texts are just the end token.  Without training texts every token is
unknown and has probability 1.  Rows with a null id are in the fold of the empty text;
repeated rows are learned from and scored each; an empty table gives an empty table.  Only the
named columns are read, whatever the others' names.  A text is worked on whole, however long: a task needs some fifty times its bytes for it.
"""
from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize
from . import ragged
from .common import _quoted, prepare, shuffle_parts
from .elias_fano import EliasFano

CHUNK_TOKENS = 1 << 21
CHUNK_TEXTS = 1 << 16
#: Tokens that a shard of bigrams stands for.
SHARD_TOKENS = 2 << 20
#: Pseudo words; a hash of a word is as unlikely to equal them as another word's.
END, START = np.uint64(0xE17D00000000E17D), np.uint64(0x57A2700000057A27)
#: At most so many frequent words (each at least 1/FREQUENT of all tokens) have short codes.
FREQUENT = (1 << 16) - 1
#: 16 decades in 16 bits.
STEP = 16 / 65535


def log_code(p: np.ndarray) -> np.ndarray:
    """Probabilities as 16-bit logarithms."""
    with np.errstate(divide="ignore"):
        return np.clip(np.rint(-np.log10(p) / STEP), 0, 65535).astype(np.uint16)


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers, narrowed to their size, byte plane by byte plane, compressed."""
    out, z = [], zstandard.ZstdCompressor(level=1)
    for a in arrays:
        a = np.ascontiguousarray(a)
        top = int(a.max()) if len(a) else 0
        width = max(1, -(-top.bit_length() // 8))
        planes = a.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T
        body = z.compress(np.ascontiguousarray(planes).tobytes())
        out.append(np.array([len(a), width, len(body)], "<u8").tobytes() + body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays, as unsigned 64-bit numbers."""
    out, at, z = [], 0, zstandard.ZstdDecompressor()
    while at < len(data):
        n, width, size = np.frombuffer(data, "<u8", 3, at).tolist()
        planes = np.frombuffer(z.decompress(data[at + 24: at + 24 + size], max_output_size=max(1, n * width)), np.uint8).reshape(width, n)
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = planes.T
        out.append(a.reshape(-1).view("<u8"))
        at += 24 + size
    return out


class Trie:
    """Contexts and their successors, in levels mapped from files of ``folder``."""

    def __init__(self, folder: str, contexts: np.ndarray, totals: np.ndarray, words: np.ndarray, pairs: np.ndarray, counts: np.ndarray, priors: np.ndarray, m: float):
        """``contexts`` (sorted) with their token counts, ``words`` (sorted); ``pairs`` (sorted) are
        ``context number * len(words) + word number``, with counts and unigram probabilities."""
        self.folder, self.files = folder, 0
        owner = (pairs // np.uint64(max(1, len(words)))).astype(np.int64)
        self.contexts, self.words = EliasFano.of(contexts, self._mapped), EliasFano.of(words, self._mapped)
        self.pointers = EliasFano.of(np.searchsorted(owner, np.arange(len(contexts) + 1)), self._mapped)
        self.successors = EliasFano.of(pairs, self._mapped)
        self.weights = self._mapped(log_code(m / (totals + m)))
        self.values = self._mapped(log_code((counts + m * priors) / (totals[owner] + m)))

    def _mapped(self, a: np.ndarray) -> np.ndarray:
        if a.size == 0:
            return a
        path = os.path.join(self.folder, str(self.files))
        self.files += 1
        a.tofile(path)
        return np.memmap(path, a.dtype, "r", shape=a.shape)

    def codes(self, context: np.ndarray, word: np.ndarray, prior: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Logarithm codes of words after contexts; ``prior`` and ``weight`` are the codes of the word's
        own probability and of the context's weight for new words."""
        out = prior.astype(np.int64) + weight
        c, w = self.contexts.find(context), self.words.find(word)
        both = np.flatnonzero((c >= 0) & (w >= 0))
        if len(both):
            c, w = c[both], w[both]
            out[both] = prior[both].astype(np.int64) + self.weights[c]
            target = c.astype(np.uint64) * np.uint64(self.words.size) + w.astype(np.uint64)
            at = self.successors.successor(target)
            inside = at < self.pointers[c + 1].astype(np.int64)
            near = np.minimum(at, self.successors.size - 1)
            hit = inside & (self.successors[near] == target)
            out[both[hit]] = self.values[near[hit]]
        return out


def _chunks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """(id, held, text) to (chunk_id, ids, held, sizes, vocabulary, trained, tokens)."""
    number = TaskContext.get().partitionId() << 32
    held_back: list[tuple] = []

    def chunk() -> pa.RecordBatch:
        nonlocal number
        ids = pa.concat_arrays([h[0] for h in held_back])
        held = np.concatenate([h[1] for h in held_back])
        sizes = np.concatenate([h[2] for h in held_back])
        hashes = np.concatenate([h[3] for h in held_back])
        held_back.clear()
        vocabulary, tokens, often = np.unique(hashes, return_inverse=True, return_counts=True)
        trained = np.bincount(tokens, weights=np.repeat(~held, sizes), minlength=len(vocabulary)).astype(np.int64)
        by = np.argsort(-often, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        row = pa.RecordBatch.from_arrays([
            pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([pack(held.astype(np.uint8))], pa.binary()), pa.array([pack(sizes)], pa.binary()),
            pa.array([pack(vocabulary[by])], pa.binary()), pa.array([pack(trained[by])], pa.binary()), pa.array([pack(rank[tokens])], pa.binary()), pa.array([len(tokens)])], names)
        number += 1
        return row

    count = texts = 0
    for batch in batches:
        for part in ragged.slices(batch, 2):
            buf, offs = ragged.flat(part.column(2))
            buf = ragged.LOWER[buf]
            starts, ends, docs = ragged.words(buf, offs)
            n = part.num_rows
            sizes = np.bincount(docs, minlength=n) + 1
            hashes = np.full(len(docs) + n, END)
            inner = np.ones(len(hashes), bool)
            inner[np.cumsum(sizes) - 1] = False
            hashes[inner] = ragged.span_hashes(buf, starts, ends)
            held_back.append((part.column(0), part.column(1).to_numpy(zero_copy_only=False).astype(bool), sizes, hashes))
            count, texts = count + len(hashes), texts + n
            if count >= CHUNK_TOKENS or texts >= CHUNK_TEXTS:
                yield chunk()
                count = texts = 0
    if held_back:
        yield chunk()


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (ragged.mix(hashes + np.uint64(0x5DEECE66D)) % np.uint64(shards)).astype(np.int64)


def _word_queries(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, trained = unpack(row["vocabulary"])[0], unpack(row["trained"])[0]
                shard = _shard_of(words, shards)
                order = np.argsort(shard, kind="stable")
                edge = np.searchsorted(shard[order], np.arange(shards + 1))
                data = [pack(words[own], trained[own]) for own in (order[a:b] for a, b in zip(edge, edge[1:], strict=False))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(shards)), pa.array(np.full(shards, row["chunk_id"])), pa.array(data, pa.binary())], ["shard", "chunk_id", "data"])
    return run


def _word_answers(shards: int):
    """For each chunk its words' counts; one more row (chunk -1) with N, V, n1, n2 and the words
    that may be frequent."""
    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        asked = [unpack(d) for d in table["data"].to_pylist()]
        words, back = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([a[1] for a in asked]).astype(np.float64), minlength=len(words)).astype(np.int64)
        edge = np.cumsum([0] + [len(a[0]) for a in asked])
        answers = [pack(total[back[a:b]]) for a, b in zip(edge, edge[1:], strict=False)]
        seen = total[total > 0]
        n = int(seen.sum())
        top = np.flatnonzero(total * (4 * FREQUENT) >= n * shards)
        top = top[total[top] > 0]
        stats = pack(np.array([n, len(seen), int((seen == 1).sum()), int((seen == 2).sum())]), words[top], total[top])
        chunks = table["chunk_id"].to_pylist()
        return pa.table({"chunk_id": pa.array([*chunks, -1], pa.int64()), "shard": pa.array([shard] * (len(chunks) + 1), pa.int64()), "data": pa.array([*answers, stats], pa.binary())})
    return run


class _Model:
    """The bounded numbers that every task knows: counts of counts and frequent words."""

    def __init__(self, stats: list[bytes], texts: int, shards: int, m: float):
        parts = [unpack(s) for s in stats]
        n, v, n1, n2 = (sum(int(p[0][k]) for p in parts) for k in range(4))
        self.tokens, self.known, self.texts, self.shards, self.m = n, v, texts, shards, m
        self.discount = n1 / (n1 + 2 * n2) if n1 else 0.0
        words = np.concatenate([np.zeros(0, np.uint64), *(p[1] for p in parts)])
        counts = np.concatenate([np.zeros(0, np.uint64), *(p[2] for p in parts)]).astype(np.int64)
        often = np.flatnonzero(counts * FREQUENT >= n)[:FREQUENT] if n else np.zeros(0, np.int64)
        often = often[np.argsort(words[often])]
        #: Frequent words in order of their hashes, and the codes of their probabilities.
        self.frequent, self.frequent_prior = words[often], log_code(self.prior(counts[often]))

    def prior(self, counts: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(counts))
        unknown = max(self.discount * self.known, 0.5) / self.tokens
        return np.where(counts > 0, (counts - self.discount) / self.tokens, unknown) / (1 + max(0.0, unknown - self.discount * self.known / self.tokens))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.known + 1)))


def _bigram_queries(model: _Model, id_kind: pa.DataType):
    """Per chunk a row for each bigram shard, and one (kind 0) with what is known by now."""
    def run(key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        words, tokens = unpack(row["vocabulary"])[0], unpack(row["tokens"])[0].astype(np.int32)
        sizes, held = unpack(row["sizes"])[0].astype(np.int64), unpack(row["held"])[0].astype(bool)
        shards = model.shards
        shard = _shard_of(words, shards)
        counts = np.zeros(len(words), np.int64)
        order = np.argsort(shard, kind="stable")
        edge = np.searchsorted(shard[order], np.arange(shards + 1))
        for s, data in zip(answers["shard"].to_pylist(), answers["data"].to_pylist(), strict=True):
            counts[order[edge[s]: edge[s + 1]]] = unpack(data)[0]
        docs = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        base = np.bincount(docs, weights=model.base(counts)[tokens], minlength=len(sizes))
        n_known = np.bincount(docs, weights=counts[tokens] > 0, minlength=len(sizes)).astype(np.int64)
        # bigrams: the context of a text's first token is its start
        words, counts = np.append(words, START), np.append(counts, model.texts)
        context = np.roll(tokens, 1)
        context[np.cumsum(sizes) - sizes] = len(words) - 1
        pair = context.astype(np.int64) * len(words) + tokens
        by = np.argsort(pair, kind="stable")
        pair = pair[by]
        opens = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        del pair
        occurrences = np.diff(np.r_[opens, len(by)])
        c, w = context[by[opens]], tokens[by[opens]]
        trained = np.add.reduceat((~held[docs[by]]).astype(np.int64), opens)
        prior = log_code(model.prior(counts))
        crowded = counts * 8 * shards > model.tokens
        to = _shard_of(np.where(crowded[c], ragged.mix(words[c]) + words[w], words[c]), shards)
        place = np.searchsorted(model.frequent, words)
        near = np.minimum(place, max(0, len(model.frequent) - 1))
        short = np.where(model.frequent[near] == words, place, FREQUENT) if len(model.frequent) else np.full(len(words), FREQUENT)
        out = []
        group = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[group], np.arange(shards + 1))
        for s in range(shards):
            g = group[edges[s]: edges[s + 1]]  # still in order of context and word
            first = np.flatnonzero(np.r_[True, c[g][1:] != c[g][:-1]]) if len(g) else g
            own = c[g][first]
            code = short[w[g]]
            posts = docs[by[ragged.ranges(opens[g], occurrences[g])]]
            out.append(pack(words[own], counts[own], np.diff(np.r_[first, len(g)]), code, words[w[g]][code == FREQUENT], prior[w[g]][code == FREQUENT], trained[g], occurrences[g], posts))
        known = pa.table({"shard": pa.array([row["chunk_id"] % shards], pa.int64()), "kind": pa.array([0], pa.int32()), "chunk_id": pa.array([row["chunk_id"]]), "data": pa.array([pack(held.astype(np.uint8), sizes, n_known)], pa.binary()),
                          "sums": pa.array([base.tobytes()], pa.binary()), "ids": pa.array([row["ids"]], pa.list_(id_kind))})
        asked = pa.table({"shard": pa.array(np.arange(shards)), "kind": pa.array([1] * shards, pa.int32()), "chunk_id": pa.array([row["chunk_id"]] * shards), "data": pa.array(out, pa.binary()),
                          "sums": pa.array([None] * shards, pa.binary()), "ids": pa.array([None] * shards, pa.list_(id_kind))})
        return pa.concat_tables([known, asked])
    return run


def _bigram_sums(model: _Model):
    """Count the shard's bigrams, build its trie, and add up each chunk's documents."""
    def run(table: pa.Table) -> pa.Table:
        passed = table.filter(pc.equal(table["kind"], 0)).select(["kind", "chunk_id", "data", "sums", "ids"])
        asked = table.filter(pc.equal(table["kind"], 1))
        if asked.num_rows == 0:
            return passed
        parts = []
        for data in asked["data"].to_pylist():
            context, total, fan, code, spelled, rare, trained, occurrences, posts = unpack(data)
            word, prior = np.zeros(len(code), np.uint64), np.zeros(len(code), np.uint16)
            long = code == FREQUENT
            word[long], prior[long] = spelled, rare
            short = code[~long].astype(np.int64)
            word[~long], prior[~long] = model.frequent[short], model.frequent_prior[short]
            fan = fan.astype(np.int64)
            parts.append((np.repeat(context, fan), np.repeat(total.astype(np.float64), fan), word, prior, trained.astype(np.int32), occurrences.astype(np.int32), posts.astype(np.int32)))
        context, total, word, prior, trained = (np.concatenate([p[k] for p in parts]) for k in range(5))
        seen = trained > 0
        contexts, at = np.unique(context[seen], return_index=True)
        totals = total[seen][at]
        words = np.unique(word[seen])
        pair = np.searchsorted(contexts, context[seen]).astype(np.uint64) * np.uint64(max(1, len(words))) + np.searchsorted(words, word[seen]).astype(np.uint64)
        pairs, first, back = np.unique(pair, return_index=True, return_inverse=True)
        counts = np.bincount(back, weights=trained[seen], minlength=len(pairs))
        priors = 10.0 ** (-STEP * prior[seen][first])
        del context, total, word, prior, trained, pair, back, seen
        sums = []
        local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        with tempfile.TemporaryDirectory(prefix="trie-", dir=local if os.path.isdir(local) else None) as folder:
            trie = Trie(folder, contexts, totals, words, pairs, counts, priors, model.m)
            for context, total, word, prior, _, occurrences, posts in parts:
                codes = trie.codes(context, word, prior, log_code(model.m / (total + model.m)))
                sums.append(pack(np.bincount(posts, weights=np.repeat(codes, occurrences)).astype(np.int64)))
        n = asked.num_rows
        found = pa.table({"kind": pa.array([1] * n, pa.int32()), "chunk_id": asked["chunk_id"].combine_chunks(), "data": pa.array([None] * n, pa.binary()), "sums": pa.array(sums, pa.binary()), "ids": pa.array([None] * n, table.schema.field("ids").type)})
        return pa.concat_tables([passed.cast(found.schema), found])
    return run


def _documents(model: _Model, names: list[str]):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        known = next(r for r in rows if r["kind"] == 0)
        held, sizes, n_known = unpack(known["data"])
        codes = np.zeros(len(sizes), np.int64)  # whole numbers: the order of adding doesn't matter
        for r in rows:
            if r["kind"] == 1:
                part = unpack(r["sums"])[0].astype(np.int64)
                codes[: len(part)] += part
        ids = table["ids"].combine_chunks().type.value_type
        return pa.table([pa.array(known["ids"], ids), pa.array(held.astype(bool)), pa.array(sizes.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(np.full(len(sizes), model.tokens)),
                         pa.array(np.frombuffer(known["sums"], np.float64)), pa.array(codes * -STEP)], names=names)
    return run


def score(df: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", m: float = 200.0) -> DataFrame:
    """Per row: the id, held_out, n_tokens, n_known, train_tokens, base_score (add-half unigrams)
    and score (the model's log10 probability of the text).  Learns from rows that are not held out."""
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(df[_quoted(id_column)].alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), df[_quoted(text_column)].alias("text"))
    id_name = rows.schema["id"].dataType.simpleString()
    id_kind = to_arrow_type(rows.schema["id"].dataType)
    names = ["chunk_id", "ids", "held", "sizes", "vocabulary", "trained", "tokens", "n"]
    chunks = materialize(rows.mapInArrow(lambda b: _chunks(b, names), f"chunk_id long, ids array<{id_name}>, held binary, sizes binary, vocabulary binary, trained binary, tokens binary, n long"), "lm-chunks")
    size = chunks.agg(F.sum("n")).first()[0] or 0
    shards = max(shuffle_parts(spark), -(-size // SHARD_TOKENS))
    asked = chunks.select("chunk_id", "vocabulary", "trained").mapInArrow(_word_queries(shards), "shard long, chunk_id long, data binary")
    answers = materialize(asked.groupBy("shard").applyInArrow(_word_answers(shards), "chunk_id long, shard long, data binary"), "lm-words")
    stats = [bytes(r["data"]) for r in answers.where("chunk_id < 0").select("data").collect()]  # one bounded row per shard
    texts = rows.where("NOT held").count()
    model = _Model(stats, texts, shards, m)
    shared = spark.sparkContext.broadcast(model)
    queries = chunks.drop("n", "trained").groupBy("chunk_id").cogroup(answers.where("chunk_id >= 0").groupBy("chunk_id")).applyInArrow(
        lambda key, a, b: _bigram_queries(shared.value, id_kind)(key, a, b), f"shard long, kind int, chunk_id long, data binary, sums binary, ids array<{id_name}>")
    sums = queries.groupBy("shard").applyInArrow(lambda t: _bigram_sums(shared.value)(t), f"kind int, chunk_id long, data binary, sums binary, ids array<{id_name}>")
    out = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return sums.groupBy("chunk_id").applyInArrow(lambda t: _documents(shared.value, out)(t), f"id {id_name}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_column)

