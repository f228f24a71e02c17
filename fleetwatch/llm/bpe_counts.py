"""Token counts of whole texts by rank-synchronous merging of byte-pair arrays.

Texts are cut into stretches of white space plus the word after it; pre-tokens
never reach beyond a stretch, so each distinct stretch is worked on once per
worker.  The pre-tokens that are new lie one after the other in one flat symbol
array.  Every round finds each pre-token's lowest-ranked adjacent pair, merges all
its places in all pre-tokens at once, and drops pre-tokens that have no pair left;
the symbols that survive are the count.

Null and empty texts have 0 tokens.  Repeated rows are counted each; an empty table
gives an empty table; other columns of the caller are not touched.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import ragged
from .common import only, prepare

NONE = np.iinfo(np.int64).max
#: White space of the vocabulary's pattern beyond ASCII, as a character class body.
WIDE_SPACE = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The pattern of byte-level vocabularies, with white space as the Unicode property
#: (Python's ``\s`` also takes the separators U+001C to U+001F).
PRE_TOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Below this every Unicode version agrees on letters and digits.
PLAIN = 0x250
#: Pre-tokens whose counts are kept; a Python object each.
KEPT_TOKENS = 1 << 17
_loaded: dict[str, "ByteMerges"] = {}


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it
    is a visible Latin-1 character, else the next free code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class ByteMerges:
    """The merge table of a vocabulary file, and a cache of counts by stretch."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        names = byte_symbols()
        self.byte_ids = np.array([vocab[names[b]] for b in range(256)], np.int64)
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << np.uint64(32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of, self.made_of = keys[order], order.astype(np.int64), made[order]
        self.counts = ragged.HashedValues()
        self.tokens: dict[str, int] = {}
        self._wide = None
        self.path = path

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs in the table, -1 where there is none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def merge(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token after all merges."""
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        counts = length.copy()
        symbols = self.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), length)

        def pairs_at(where: np.ndarray) -> np.ndarray:
            inside = where[where + 1 < len(symbols)]
            at = np.full(len(where), -1)
            at[: len(inside)] = np.where(owner[inside] == owner[inside + 1], self._lookup(symbols[inside], symbols[np.minimum(inside + 1, len(symbols) - 1)]), -1)
            return at

        place = pairs_at(np.arange(len(symbols)))
        while len(symbols):
            rank = np.where(place >= 0, self.rank_of[place], NONE)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[starts, len(symbols)])
            lowest = np.minimum.reduceat(rank, starts)
            over = lowest == NONE
            counts[owner[starts[over]]] = size[over]
            if over.all():
                break
            live = np.repeat(~over, size)
            symbols, owner, place, rank = symbols[live], owner[live], place[live], rank[live]
            hit = rank == np.repeat(lowest[~over], size[~over])
            # in a run of one symbol the pairs overlap: take every second from its left end
            at = np.arange(len(hit))
            opens = hit & ~np.r_[False, hit[:-1]]
            hit &= (at - np.maximum.accumulate(np.where(opens, at, 0))) % 2 == 0
            symbols[hit] = self.made_of[place[hit]]
            stays = ~np.r_[False, hit[:-1]]
            symbols, owner, place, hit = symbols[stays], owner[stays], place[stays], hit[stays]
            touched = np.flatnonzero(hit | np.r_[hit[1:], False])
            place[touched] = pairs_at(touched)
        return counts

    def _pre_tokens(self, text: str) -> list[str]:
        if text.isascii() or max(text) < chr(PLAIN):
            return PRE_TOKEN.findall(text)
        if self._wide is None:  # the library's own splitter knows its Unicode version
            from tokenizers import pre_tokenizers
            self._wide = pre_tokenizers.ByteLevel(add_prefix_space=False)
        return [text[a:b] for _, (a, b) in self._wide.pre_tokenize_str(text)]

    def count(self, stretches: list[str]) -> np.ndarray:
        """Tokens of each stretch; special strings are one token each."""
        cut, extra = [], np.zeros(len(stretches), np.int64)
        for k, s in enumerate(stretches):
            if self.split is not None and "<" in s and (found := len(self.split.findall(s))):
                extra[k] = found
                cut.append([t for part in self.split.split(s) if part for t in self._pre_tokens(part)])
            else:
                cut.append(self._pre_tokens(s))
        new = list({t for ts in cut for t in ts if t not in self.tokens})
        if len(self.tokens) + len(new) > KEPT_TOKENS:
            self.tokens = {}
            new = list({t for ts in cut for t in ts})
        for a in range(0, len(new), 1 << 16):
            part = new[a: a + (1 << 16)]
            self.tokens.update(zip(part, self.merge([t.encode("utf-8") for t in part]).tolist(), strict=True))
        known = self.tokens
        return extra + np.fromiter((sum([known[t] for t in ts]) for ts in cut), np.int64, len(cut))

    def totals(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        buf, offs = ragged.flat(texts)
        starts, ends = stretches(buf, offs, ~pc.fill_null(pc.match_substring_regex(texts, f"[{WIDE_SPACE}]"), False).to_numpy(zero_copy_only=False))
        if len(starts) == 0:
            return np.zeros(len(texts), np.int64)
        keys = ragged.span_hashes(buf, starts, ends)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        values, known = self.counts.find(distinct)
        todo = np.flatnonzero(~known)
        if len(todo):
            values[todo] = self.count(ragged.text_pieces(buf, starts[first[todo]], ends[first[todo]]))
            self.counts.add(distinct[todo], values[todo])
        return ragged.sums(values[back], ragged.documents_of(starts, offs), len(texts))


def byte_merges(path: str) -> ByteMerges:
    if path not in _loaded:
        _loaded[path] = ByteMerges(path)
    return _loaded[path]


def stretches(buf: np.ndarray, offs: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of white space plus the word after it (at a text's end, white space alone);
    texts that ``cut`` leaves out are one span."""
    _, ends, docs = ragged.words(buf, offs)
    ends = ends[cut[docs]] if len(ends) else ends
    filled = offs[1:][offs[1:] > offs[:-1]]
    ends = np.unique(np.concatenate([ends, filled]))
    starts = np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1]])
    return starts, ends


def count_tokens(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 512) -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).

    ``vocabulary`` is the path of a byte-level vocabulary on the workers.  One narrow
    pass: no shuffle, memory bounded by a batch of texts and the caches."""
    prepare(df.sparkSession)
    rows = only(df, id=id_column, text=text_column)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = byte_merges(vocabulary)
        for batch in batches:
            for part in ragged.slices(batch, 1):
                n = merges.totals(part.column(1))
                size = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_column)
