"""SentencePiece encoding and decoding by batched numpy Viterbi.

A text is cut before every run of blanks; no piece goes beyond such a cut, so each
distinct word is encoded once per batch.  Words of equal length advance together, one
position at a time: the hashes of all substrings that end there probe the sorted hashes
of the pieces, and the best piece that fits the path before it is kept as the
backpointer of that position.

For a unigram model the best piece would be that of the largest summed score.  The
given model is a byte-pair model, whose library merges pairs in order of score; the
sum of scores gives other pieces.  So a candidate has to be *compatible* with the piece
before it: undoing the later of the two pieces' last merges again and again, no pair
across the border may have come earlier in the order.  A path of pairwise compatible
pieces is exactly what the merging gives, and at every position one candidate is
compatible, so the maximum over compatible candidates follows the library.

Characters that are no pieces become byte pieces.  Null and empty texts have no pieces.
Words of more than ``LONGEST`` characters, and texts that hold the blank sign U+2581 or
U+0000 themselves, are encoded by the library.  Repeated rows are encoded each; an empty
table gives an empty table; other columns of the caller are not touched.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import ragged
from .common import only, prepare

BLANK = "▁"
LONGEST = 512
LATE = np.iinfo(np.int64).max
_loaded: dict[str, "Pieces"] = {}


def pieces(path: str) -> "Pieces":
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


class Pieces:
    """The pieces of a model as sorted arrays, and the ids of the words met so far."""

    LIMIT = 1 << 20
    #: Places for the endings of pieces.
    ENDINGS = 1 << 18

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.library = lib = SentencePieceProcessor(model_file=path)
        self.size = lib.get_piece_size()
        self.byte_ids = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        plain = [i for i in range(self.size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i))]
        text = {i: lib.id_to_piece(i) for i in plain}
        words = [i for i in plain if text[i] == BLANK or text[i].strip(BLANK)]
        number = {text[i]: i for i in words}
        order = sorted((i for i in words if len(text[i]) > 1), key=lambda i: (-lib.get_score(i), i))
        #: Order in which pieces are merged; single characters are there from the start.
        self.rank = np.full(self.size + 1, -1, np.int64)
        self.rank[order] = np.arange(len(order))
        self.left, self.right = np.arange(self.size + 1), np.arange(self.size + 1)
        reached = [i for i in words if len(text[i]) == 1]
        pairs: list[tuple[int, int, int]] = []
        for i in order:
            t = text[i]
            pairs += [(number[t[:k]], number[t[k:]], i) for k in range(1, len(t)) if t[:k] in number and t[k:] in number]
            found = self._last_merge(t, number)
            if found:
                self.left[i], self.right[i] = found
                reached.append(i)
        keys = np.array([a << 32 | b for a, b, _ in pairs], np.uint64)
        by = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank = keys[by], self.rank[np.array([c for _, _, c in pairs])][by]
        # hashes of the pieces that merging can give
        flat = np.array([ord(c) for i in reached for c in text[i]], np.uint64)
        length = np.array([len(text[i]) for i in reached])
        hashes = ragged.span_hashes(flat, np.cumsum(length) - length, np.cumsum(length))
        by = np.argsort(hashes, kind="stable")
        self.hashes, self.ids_of = hashes[by], np.array(reached)[by]
        self.widest = int(length.max())
        # which lengths have pieces that end in these three characters
        long = np.flatnonzero(length >= 3)
        ends = np.cumsum(length)[long]
        self.endings = np.zeros(self.ENDINGS, np.int64)
        np.bitwise_or.at(self.endings, (ragged.span_hashes(flat, ends - 3, ends) % np.uint64(self.ENDINGS)).astype(np.int64), 1 << length[long])
        self.lengths = np.ones(self.size + 1, np.int64)
        self.lengths[reached] = length
        self.blank = number[BLANK]
        # bytes of every piece, for decoding
        raw = [b"" if lib.is_control(i) else b" \xe2\x81\x87 " if lib.is_unknown(i) else bytes([int(lib.id_to_piece(i)[3:5], 16)]) if lib.is_byte(i)
               else lib.id_to_piece(i).replace(BLANK, " ").encode("utf-8") for i in range(self.size)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_length = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_length) - self.raw_length
        self._clear()

    def _clear(self) -> None:
        self.found = ragged.HashedValues(self.LIMIT)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _last_merge(self, t: str, number: dict[str, int]) -> tuple[int, int] | None:
        """The two pieces that the piece's own text ends up as before the last merge."""
        parts = list(t)
        while len(parts) > 2:
            ranks = [(self.rank[number[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in number and len(a + b) < len(t)]
            if not ranks:
                return None
            k = min(ranks)[1]
            parts[k: k + 2] = [parts[k] + parts[k + 1]]
        return (number[parts[0]], number[parts[1]]) if parts[0] in number and parts[1] in number else None

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves a border between the pieces a and b."""
        out = np.ones(len(a), bool)
        left = np.arange(len(a))
        before = np.full(len(a), LATE)
        while len(left):
            keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            merged = np.where(self.pair_keys[at] == keys, self.pair_rank[at], LATE)
            wrong = merged < before
            out[left[wrong]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~wrong & ((ra >= 0) | (rb >= 0))
            a, b, left, ra, rb = a[on], b[on], left[on], ra[on], rb[on]
            undo_a = ra > rb
            # a pair over the border that merges like b stands to its left and so comes first
            before = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return out

    def _equal_length(self, codes: np.ndarray) -> np.ndarray:
        """Tokens of words of one length (words x characters), -1 where a word has no more; unknown
        characters are ``size``."""
        n, size = codes.shape
        substrings = ragged.Substrings(codes.ravel())
        last = np.full((n, size + 1), -1, np.int64)
        rows = np.arange(n)
        for j in range(1, size + 1):
            open_ = np.ones(n, bool)
            lengths = self.endings[(substrings.hashes(rows * size + j - 3, 3) % np.uint64(self.ENDINGS)).astype(np.int64)] if j >= 3 else np.zeros(n, np.int64)
            for k in range(min(j, self.widest), 0, -1):
                todo = rows[open_ & (lengths >> k & 1).astype(bool)] if k >= 3 else rows[open_]
                if len(todo) == 0:
                    continue
                start = todo * size + j - k
                h = substrings.hashes(start, k)
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = self.hashes[at] == h
                piece = np.where(hit, self.ids_of[at], self.size if k == 1 else -1)
                todo, piece = todo[piece >= 0], piece[piece >= 0]
                if j > k:
                    fits = self._compatible(last[todo, j - k], piece)
                    todo, piece = todo[fits], piece[fits]
                last[todo, j] = piece
                open_[todo] = False
        place, back = np.full(n, size), []
        while (place > 0).any():
            token = np.where(place > 0, last[rows, place], -1)
            back.append(token)
            place = np.where(place > 0, place - self.lengths[token], 0)
        return np.stack(back[::-1], axis=1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word after one blank, one word after the other, and how many each has."""
        length = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # words, their ids
        size = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(size).tolist():
            where = np.flatnonzero(size == n)
            if n > LONGEST:
                for w in where.tolist():
                    ids = np.array(self.library.encode(words[w]), np.int32)
                    length[w] = len(ids)
                    parts.append((where[where == w], ids))
                continue
            for a in range(0, len(where), 1 << 15):
                part = where[a: a + (1 << 15)]
                codes = np.frombuffer((BLANK + BLANK.join(words[w] for w in part)).encode("utf-32-le"), np.uint32).reshape(len(part), n + 1)
                grid = self._equal_length(codes)
                odd = (grid == self.size).any(axis=1)
                plain, tokens = part[~odd], grid[~odd]
                length[plain] = (tokens >= 0).sum(axis=1)
                parts.append((plain, tokens[tokens >= 0]))
                for w, row in zip(part[odd].tolist(), grid[odd], strict=True):
                    ids = self._with_bytes(words[w], row[row >= 0])
                    length[w] = len(ids)
                    parts.append((np.array([w]), ids))
        out, at = np.zeros(int(length.sum()), np.int32), np.cumsum(length) - length
        for where, ids in parts:
            out[ragged.ranges(at[where], length[where])] = ids
        return out, length

    def _with_bytes(self, word: str, tokens: np.ndarray) -> np.ndarray:
        ids, at, text = [], 0, BLANK + word
        for t in tokens.tolist():
            ids += self.byte_ids[list(text[at].encode("utf-8"))].tolist() if t == self.size else [t]
            at += int(self.lengths[t])
        return np.array(ids, np.int32)

    def _learn(self, keys: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        total = len(ids)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used: self.used + total] = ids
        self.found.add(keys, len(self.at) + np.arange(len(keys)))
        self.at = np.concatenate([self.at, self.used + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.used += total

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys that have been learned."""
        places, known = self.found.find(keys)
        if not known.all():
            raise LookupError("a word of the batch is not in the cache")
        return places

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after the other, and their offsets."""
        texts = pc.fill_null(texts, "")
        own = pc.match_substring_regex(texts, "[▁\\x00]").to_numpy(zero_copy_only=False)
        if own.any():
            return self._with_library(texts, own)
        buf, offs = ragged.flat(texts)
        n = len(texts)
        # the blank before every text
        filled = offs[1:] > offs[:-1]
        wide = np.full(len(buf) + int(filled.sum()), 0x20, np.uint8)
        edges = offs + np.r_[0, np.cumsum(filled)]
        inner = np.ones(len(wide), bool)
        inner[edges[:-1][filled]] = False
        wide[inner] = buf
        blank = wide == 0x20
        starts = np.flatnonzero(blank & ~np.r_[False, blank[:-1]] | ~inner)
        if len(starts) == 0:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        ends = np.r_[starts[1:], len(wide)]
        total = np.concatenate([[0], np.cumsum(blank)])
        run = total[ends] - total[starts]
        docs = ragged.documents_of(starts, edges)
        begin = starts + run
        keys, first, back = np.unique(ragged.span_hashes(wide, begin, ends), return_index=True, return_inverse=True)
        runs = np.unique(run)
        lone = np.union1d(runs, runs - 1)  # runs of blanks by themselves
        lone = lone[lone > 0].tolist()
        need = len(keys) + len(lone)
        if len(self.at) + need > self.LIMIT:
            self._clear()
            self.found.limit = max(self.LIMIT, need)  # a slice is not split: its words are kept together, however many
        new = np.flatnonzero(~self.found.find(keys)[1])
        if len(new):
            self._learn(keys[new], *self.encode_words(ragged.text_pieces(wide, begin[first[new]], ends[first[new]])))
        for r in lone:
            key = ragged.mix(np.array([r + (1 << 40)], np.uint64))
            if not self.found.find(key)[1][0]:
                ids = np.array(self.library.encode(" " * (r - 1)) if r > 1 else [self.blank], np.int32)
                self._learn(key, ids, np.array([len(ids)]))
        word = self._places(keys)[back]
        at, length = self.at[word], self.length[word]
        alone = begin == ends  # blanks at a text's end
        opens = np.where(length > 0, self.ids[np.minimum(at, max(self.used - 1, 0))] == self.blank, False)
        joins = (run > 1) & opens & ~alone
        lead = np.where(alone | joins, run, run - 1)
        lead_at, lead_length = np.zeros(len(run), np.int64), np.zeros(len(run), np.int64)
        some = np.flatnonzero(lead > 0)
        if len(some):
            w = self._places(ragged.mix(lead[some].astype(np.uint64) + np.uint64(1 << 40)))
            lead_at[some], lead_length[some] = self.at[w], self.length[w]
        at, length = at + joins, np.where(alone, 0, length - joins)
        where, size = np.stack([lead_at, at], 1).ravel(), np.stack([lead_length, length], 1).ravel()
        ids = self.ids[ragged.ranges(where, size)]
        per = ragged.sums(lead_length + length, docs, n)
        return ids, np.concatenate([[0], np.cumsum(per)])

    def _with_library(self, texts: pa.Array, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        masked = pc.if_else(pa.array(own), pa.scalar("", texts.type), texts)
        ids, edges = self.encode(masked)
        parts = [ids[edges[k]: edges[k + 1]] for k in range(len(texts))]
        for k in np.flatnonzero(own).tolist():
            parts[k] = np.array(self.library.encode(texts[k].as_py()), np.int32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[str]:
        """The texts of these ids."""
        size = self.raw_length[ids]
        raw = self.raw[ragged.ranges(self.raw_at[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[edges].tolist()
        return [raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(ends, ends[1:], strict=False)]


def encode(df: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, the piece ids (array of int), n_pieces, ids_crc32 (of the ids as
    little-endian 32-bit numbers) and round_trip: whether decoding them gives the text.
    ``model`` is the path of a model on the workers.  One narrow pass."""
    prepare(df.sparkSession)
    rows = only(df, id=id_column, text=text_column)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for batch in batches:
            for part in ragged.slices(batch, 1):
                ids, edges = table.encode(part.column(1))
                same = pa.array(table.decode(ids, edges), pa.string())
                raw = ids.astype("<i4")
                crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
                equal = pc.equal(same, pc.fill_null(part.column(1), "").cast(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(edges)), pa.array(crc, pa.int64()), equal], ["id", "ids", "n_pieces", "ids_crc32", "round_trip"])

    return rows.mapInArrow(run, f"id {kind}, ids array<int>, n_pieces long, ids_crc32 long, round_trip boolean").withColumnRenamed("id", id_column)


def decode(df: DataFrame, model: str, ids_column: str = "ids", text_column: str = "text") -> DataFrame:
    """The texts of the rows' piece ids, one column; a null list gives null."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for batch in batches:
            lists = batch.column(0)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = table.decode(ids, np.concatenate([[0], np.cumsum(size)]))
            yield pa.RecordBatch.from_arrays([pc.if_else(lists.is_valid(), pa.array(texts, pa.string()), pa.scalar(None, pa.string()))], [text_column])

    return only(df, ids=ids_column).mapInArrow(run, f"`{text_column}` string")
