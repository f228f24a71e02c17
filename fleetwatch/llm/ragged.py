"""Arrow string columns as flat numpy arrays: words, their hashes and per-document sums.

A batch of texts is one byte array and the offsets of its documents.  Words are
``(start, end)`` spans in it, so a whole batch is cut, hashed and counted without
a Python object per word.
"""
from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once (a longer text makes a longer batch).
BATCH_BYTES = 2 << 20

#: Space, tab, line feed, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: glibc's; other libraries give freed memory back on their own.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_powers = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: Powers are made this many at a time.
_POWERS = 1 << 18


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (int64, one more than documents); null counts as empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset: texts.offset + n + 1].astype(np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0]: offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: int | str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``limit`` bytes together."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Memory that is free again goes back to the system: workers live on, with the next operator's tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of ``[^\\x20\\x09-\\x0D]+`` and the document of each: starts, ends, docs."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~IS_SPACE[buf]
    first = np.zeros(len(buf), bool)
    first[offs[:-1][offs[:-1] < len(buf)]] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | first[1:]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, documents_of(starts, offs)


def documents_of(positions: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.searchsorted(offs, positions, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a multiply-xorshift finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = -(-n // _POWERS) * _POWERS
        for k, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def forget_powers() -> None:
    """The powers are made again when they are needed, and only as many as are."""
    _powers.update(n=0, up=np.ones(1, np.uint64), down=np.ones(1, np.uint64))


def _running(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``item * base**position`` before each position, made in place, and the powers both ways."""
    up, down = _grown(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    inner = total[1:]
    inner[:] = values
    inner += np.uint64(1)
    inner *= up[: len(values)]
    np.cumsum(inner, out=inner)
    return total, up, down


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[start:end]`` for each span (bytes, or 64-bit items).

    Sums of ``item * base**position`` modulo 2**64, moved to position 0; the length
    is mixed in.  Equal spans have equal hashes in every batch and process."""
    total, _, down = _running(values)
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Substrings:
    """Hashes of many spans of one array, from sums that are made once."""

    def __init__(self, values: np.ndarray):
        self.total, self.up, self.down = _running(values)

    def hashes(self, starts: np.ndarray, size: int) -> np.ndarray:
        """As ``span_hashes`` of the spans of this size."""
        h = (self.total[starts + size] - self.total[starts]) * self.down[starts]
        return mix(h + np.uint64(size * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start+1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def sums(values: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums of ``values`` by document."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    edge = np.searchsorted(docs, np.arange(n + 1), "left")
    return total[edge[1:]] - total[edge[:-1]]


def text_pieces(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    raw = buf.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class HashedValues:
    """A growing map from 64-bit hashes to a number each, kept as sorted arrays.

    Only a cache of what can be worked out again: at ``limit`` entries it starts
    afresh, so a worker's memory is bounded however many words it meets."""

    def __init__(self, limit: int = 1 << 19):
        self.keys, self.values, self.limit = np.zeros(0, np.uint64), np.zeros(0, np.int64), limit

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of ``keys`` and which of them are known."""
        if len(self.keys) == 0:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[at], self.keys[at] == keys

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Take in new keys, in ascending order."""
        if len(self.keys) + len(keys) > self.limit:
            self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.values = np.insert(self.keys, at, keys), np.insert(self.values, at, values)
