"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

Every task packs the documents of its own partition, a chunk of some million tokens
at a time, so nothing is shuffled and no group of documents has to meet in one task.
In a chunk each document gives full sequences and one rest; the rests are taken
longest first, and each goes to the sequence of lowest estimated cost that has room.
A piece costs ``linear * n + quadratic * n**2``: attention within a piece grows with
its square.  Only when no sequence has room, the piece is cut and fills the cheapest
one.  A chunk opens as many sequences as its tokens need, so at
most one sequence's worth of padding is left in a chunk.

A null text counts as empty and gives just the end id.  Repeated rows are packed each;
an empty table gives an empty table; other columns of the caller are not touched.  A
text of any length is cut over as many sequences as it needs.
"""
from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import ragged
from .bpe_counts import byte_symbols
from .common import only, prepare

#: Tokens after which a task packs what it has.
CHUNK_TOKENS = 4 << 20
#: Bytes of text after which a task looks whether its chunk is full.
SLICE_BYTES = 1 << 20
#: Bytes of text that become ids at once; what that takes on the way is some forty times as much.
STEP_BYTES = 1 << 18
#: Letters of one case folding and one composition everywhere.
PLAIN = 0x250
_loaded: dict[str, "WordIds"] = {}


class _Generation:
    """Ids of words by hash, as flat arrays."""

    def __init__(self, limit: int):
        self.found = ragged.HashedValues(limit)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """New words in ascending order of ``keys``, with their ids one after the other."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used: self.used + len(ids)] = ids
        self.found.add(keys, len(self.at) + np.arange(len(keys)))
        self.at = np.concatenate([self.at, self.used + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.used += len(ids)


class WordIds:
    """Token ids by word, from the vocabulary's library; a word never depends on its
    neighbours in a vocabulary that drops white space.  Kept per worker in two generations of
    flat arrays: words go to the younger one; when that is full it becomes the older one,
    and words that are met again move up, so only what was not met for a whole generation is
    forgotten.

    The library looks for special strings in the raw text, before lower-casing, so
    words with the beginning of one keep their case until they are encoded."""

    #: The cut of a word before the merges.
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
    #: Words of a generation (some 40 bytes each).
    LIMIT = 1 << 18
    #: Parts of words of a generation; a Python object each.
    PARTS_LIMIT = 1 << 15

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: The first two bytes of every special string.
        self.marks = sorted({tuple(s.encode()[:2].ljust(2)) for s in self.special})
        names = byte_symbols()
        #: Letters below PLAIN as the symbols of their bytes, two at most.
        self.symbols = {c: "".join(names[b] for b in chr(c).encode("utf-8")) for c in range(PLAIN)}
        self.young, self.old = _Generation(self.LIMIT), _Generation(self.LIMIT)
        self.parts: dict[str, list[int]] = {}
        self.old_parts: dict[str, list[int]] = {}

    def encode(self, word: str) -> list[int]:
        """As the library's ``encode(word, add_special_tokens=False).ids``; plain words skip
        its per-call work and go to its merge model part by part."""
        ascii = word.isascii()
        if not (ascii or max(word) < chr(PLAIN) and "İ" not in word) or ("<" in word and any(s in word for s in self.special)):
            return self.library.encode(word, add_special_tokens=False).ids
        low = word.lower()
        if low.isalpha():
            return self._part(low)
        out: list[int] = []
        for part in self.PARTS.findall(low):
            out += self._part(part)
        return out

    def _part(self, part: str) -> list[int]:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.old_parts.get(part)
            if ids is None:
                plain = part.isascii() and part.isprintable()  # its own symbols
                ids = [t.id for t in self.model.tokenize(part if plain else part.translate(self.symbols))]
            if len(self.parts) >= self.PARTS_LIMIT:
                self.old_parts, self.parts = self.parts, {}
            self.parts[part] = ids
        return ids

    def _known(self, buf: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """All ``keys`` are in the younger generation after this; their places there."""
        if len(self.young.at) + len(keys) > self.LIMIT and len(self.young.at):
            self.old, self.young = self.young, _Generation(self.LIMIT)
        if len(keys) > self.young.found.limit:  # one text with more words than a generation
            self.young.found.limit = len(keys)
        young, old = self.young, self.old
        missing = np.flatnonzero(~young.found.find(keys)[1])
        place, again = old.found.find(keys[missing])
        moved, new = missing[again], missing[~again]
        at, length = old.at[place[again]], old.length[place[again]]
        if len(moved):
            young.add(keys[moved], old.ids[ragged.ranges(at, length)], length)
        if len(new):
            ids = [self.encode(w) for w in ragged.text_pieces(buf, starts[new], ends[new])]
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            young.add(keys[new], np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum())), length)
        return young.found.find(keys)[0]

    def _lowered(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes in lower case, but for words that may hold a special string, and the words."""
        starts, ends, docs = ragged.words(buf, offs)
        low = ragged.LOWER[buf]
        for a, b in self.marks:
            at = np.flatnonzero((buf[:-1] == a) & (buf[1:] == b))
            w = np.unique(np.searchsorted(starts, at, "right") - 1)
            w = w[w >= 0]
            keep = ragged.ranges(starts[w], ends[w] - starts[w])
            low[keep] = buf[keep]
        return low, starts, ends, docs

    def documents(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each followed by ``end_id``, and their offsets."""
        buf, offs = ragged.flat(texts)
        buf, starts, ends, docs = self._lowered(buf, offs)
        keys, first, back = np.unique(ragged.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        where = self._known(buf, keys, starts[first], ends[first])[back] if len(keys) else np.zeros(0, np.int64)
        length = self.young.length[where]
        n = len(texts)
        per = ragged.sums(length, docs, n) + 1
        edges = np.concatenate([[0], np.cumsum(per)])
        out = np.full(int(edges[-1]), end_id, np.uint32)
        inner = np.ones(len(out), bool)
        inner[edges[1:] - 1] = False
        out[inner] = self.young.ids[ragged.ranges(self.young.at[where], length)]
        return out, edges

    def steps(self, part: pa.RecordBatch, end_id: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Of rows (id, text): the ids of some documents, their tokens one after the other, and how many each has."""
        for step in ragged.slices(part, 1, STEP_BYTES):
            flat, edges = self.documents(step.column(1), end_id)
            # a copy: the ids of a batch share its memory, which is mostly text
            yield step.column(0).take(pa.array(np.arange(step.num_rows))), flat, np.diff(edges)


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


class Rooms:
    """Sequences by the room they have left: a heap by cost for each room, and a tree over the
    rooms of the cheapest sequence in each, so the cheapest with enough room is found exactly."""

    NONE = (float("inf"), -1)

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.levels: dict[int, list[tuple[float, int]]] = {}
        self.best = [self.NONE] * (2 * self.width)

    def _update(self, room: int) -> None:
        at, level = self.width + room, self.levels[room]
        self.best[at] = level[0] if level else self.NONE
        while at > 1:
            at >>= 1
            self.best[at] = min(self.best[2 * at], self.best[2 * at + 1])

    def put(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.levels.setdefault(room, []), (cost, sequence))
        self._update(room)

    def cheapest(self, room: int) -> tuple[float, int]:
        """Cost and number of the cheapest sequence with at least this room, else NONE."""
        at = self.width + room
        found = self.best[at]
        while at > 1:
            if at % 2 == 0:
                found = min(found, self.best[at + 1])
            at >>= 1
        return found

    def take(self, room: int) -> None:
        """Remove the cheapest sequence of exactly this room."""
        heapq.heappop(self.levels[room])
        self._update(room)


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of documents of these lengths."""
    out, rests, sequences = [], [], 0
    for d, n in enumerate(lengths):
        full = n // capacity
        out += [(d, k * capacity, capacity, sequences + k, 0) for k in range(full)]
        sequences += full
        if n % capacity:
            rests.append((n % capacity, d, full * capacity))
    rests.sort(key=lambda r: (-r[0], r[1]))
    opened = -(-sum(r[0] for r in rests) // capacity)
    filled = [0] * opened
    rooms = Rooms(capacity)
    for s in range(opened):
        rooms.put(capacity, 0.0, s)
    for n, d, start in rests:
        while n:
            cost, s = rooms.cheapest(n)
            if s < 0:
                cost, s = rooms.cheapest(1)
            room = capacity - filled[s]
            rooms.take(room)
            part = min(n, room)
            out.append((d, start, part, sequences + s, filled[s]))
            filled[s] += part
            start, n = start + part, n - part
            if filled[s] < capacity:
                rooms.put(room - part, cost + linear * part + quadratic * part * part, s)
    return out


def pack(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = 2048,
         end_id: int = 1, linear: float = 1.0, quadratic: float = 1.0 / 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, if asked for, the ids as little-endian unsigned 32-bit numbers.

    ``sequence_id`` holds the task in its upper half, so it is unique in the result."""
    prepare(df.sparkSession)
    rows = only(df, id=id_column, text=text_column)
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base = word_ids(vocabulary), TaskContext.get().partitionId() << 32
        ragged.forget_powers()  # those of an operator before may be many more than a step needs
        held: list[tuple[pa.Array, np.ndarray]] = []
        chunk = np.empty(CHUNK_TOKENS + SLICE_BYTES, np.uint32)  # one for all chunks; a longer text makes it longer

        def packed() -> pa.RecordBatch:
            nonlocal base
            ids, flat = pa.concat_arrays([h[0] for h in held]), chunk[:tokens]
            per = np.concatenate([h[1] for h in held])
            held.clear()
            at = np.cumsum(per) - per
            piece = np.array(balance(per.tolist(), capacity, linear, quadratic), np.int64).reshape(-1, 5)
            doc, start, length, sequence, offset = piece.T
            raw = flat.astype("<u4", copy=False)
            spans = [raw[a: a + n] for a, n in zip((at[doc] + start).tolist(), length.tolist(), strict=True)]
            crc = np.fromiter((zlib.crc32(memoryview(s).cast("B")) for s in spans), np.int64, len(spans))
            columns = [ids.take(pa.array(doc)), *(pa.array(c) for c in (start, length, crc, per[doc], base + sequence, offset))]
            base += int(sequence.max()) + 1
            return pa.RecordBatch.from_arrays(columns + [pa.array([s.tobytes() for s in spans], pa.binary())] * with_ids, names)

        tokens = 0
        for batch in batches:
            for part in ragged.slices(batch, 1, SLICE_BYTES):
                for ids, flat, per in words.steps(part, end_id):
                    if tokens + len(flat) > len(chunk):
                        chunk = np.concatenate([chunk[:tokens], np.empty(len(flat), np.uint32)])
                    chunk[tokens: tokens + len(flat)] = flat
                    held.append((ids, per))
                    tokens += len(flat)
                if tokens >= CHUNK_TOKENS:
                    yield packed()
                    tokens = 0
        if held:
            yield packed()

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
