import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from fleetwatch.llm import packing, ragged

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


def _check(df, texts, capacity=2048):
    library = Tokenizer.from_file(PATH)
    ids = {k: library.encode(t or "", add_special_tokens=False).ids + [1] for k, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(df, PATH, capacity=capacity, with_ids=True).collect():
        part = np.array(ids[r.doc_id][r.start: r.start + r.length], "<u4").tobytes()
        assert (zlib.crc32(part), part, r.doc_tokens) == (r.ids_crc32, bytes(r.ids), len(ids[r.doc_id]))
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, v in ids.items():  # each id in exactly one piece
        at = 0
        for start, n in sorted(pieces[k]):
            assert start == at and n > 0
            at += n
        assert at == len(v)
    short = 0
    for v in sequences.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= capacity
        short += capacity - at
    return short, len(sequences)


def test_every_id_once_and_little_padding(docs, small):
    texts = dict(enumerate(ODD + [r.text for r in small.select("text").collect()]))
    df = docs(list(texts.items())).coalesce(1)
    short, _ = _check(df, texts)
    assert short < 2048
    short, _ = _check(df, texts, capacity=64)
    assert short < 64


def test_balance_prefers_cheap_sequences():
    pieces = packing.balance([60, 60, 40, 40], 100, 1.0, 1.0)
    by = defaultdict(list)
    for d, _, n, s, _ in pieces:
        by[s].append(n)
    assert sorted(map(sorted, by.values())) == [[40, 60], [40, 60]]


def test_empty_table_null_ids_and_clashing_columns(docs):
    assert packing.pack(docs([]), PATH).count() == 0
    rows = docs([(None, "one two", 1), (None, None, 2)], "doc_id long, text string, offset int")
    assert sorted(r.length for r in packing.pack(rows, PATH).collect()) == [1, 3]


def _greedy(lengths, capacity, linear, quadratic):
    """Rests longest first to the cheapest of all sequences with room; lengths below the capacity."""
    out, opened = [], -(-sum(lengths) // capacity)
    filled, cost = [0] * opened, [0.0] * opened
    for d in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        start, n = 0, lengths[d]
        while n:
            s = min((s for s in range(opened) if filled[s] < capacity), key=lambda s: (capacity - filled[s] < n, cost[s], s))
            part = min(n, capacity - filled[s])
            out.append((d, start, part, s, filled[s]))
            filled[s], cost[s] = filled[s] + part, cost[s] + linear * part + quadratic * part * part
            start, n = start + part, n - part
    return out


def test_a_piece_is_cut_only_when_no_sequence_has_room():
    import random
    for seed, (least, most) in enumerate([(1, 99), (30, 99), (1, 40), (20, 60), (50, 99)] * 3):
        rnd = random.Random(seed)
        lengths = [rnd.randint(least, most) for _ in range(400)]
        assert packing.balance(lengths, 100, 1.0, 1 / 1024) == _greedy(lengths, 100, 1.0, 1 / 1024)


def _words(seed, n):
    import random
    rnd = random.Random(seed)
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|StartOfText|>", "<|", "|>", "<", "end", "OF", "text", "'s", "'LL", "don't", "É", "ß", "İ", "ſ", "ª²", "½", "日本", "12", "9", "!", "...", "#$%", "\x07", "\x7f",
            "​", "́", "a", "Z", "th", "ing", "QUE", "éè"]
    return [" ".join("".join(rnd.choice(bits) for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(1, 6))) for _ in range(n)]


def test_ids_of_random_texts_are_the_librarys(monkeypatch):
    """Special strings in any case and glued to words, with caches that turn over often."""
    import pyarrow as pa
    library = Tokenizer.from_file(PATH)
    monkeypatch.setattr(packing.WordIds, "LIMIT", 300)
    monkeypatch.setattr(packing.WordIds, "PARTS_LIMIT", 50)
    words = packing.WordIds(PATH)
    for seed in range(20):
        texts = _words(seed, 500)
        ids, edges = words.documents(pa.array(texts), 1)
        want = library.encode_batch(texts, add_special_tokens=False)
        assert all(ids[a: b - 1].tolist() == w.ids and ids[b - 1] == 1 for a, b, w in zip(edges[:-1], edges[1:], want, strict=True))


def test_words_that_are_met_again_are_kept(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(packing.WordIds, "LIMIT", 100)
    words = packing.WordIds(PATH)
    asked = []
    encode = words.encode
    monkeypatch.setattr(words, "encode", lambda w: asked.append(w) or encode(w))
    for k in range(30):
        words.documents(pa.array([f"often {' '.join(f'w{k}x{j}' for j in range(40))}"]), 1)
    assert asked.count("often") == 1 and len(asked) == 1 + 30 * 40


def test_hashing_works_in_place():
    text = np.full(1 << 20, ord("a"), np.uint8)
    text[::64] = 32
    starts = np.arange(1, len(text), 64)
    ragged.span_hashes(text, starts, starts + 63)  # the powers are made once
    tracemalloc.start()
    found = ragged.span_hashes(text, starts, starts + 63)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(found.tolist())) == 1
    assert peak < 12 * len(text)  # one number of 8 bytes for each byte, and the spans'; 16 before


def test_texts_become_ids_in_small_steps():
    """What a worker holds on the way follows from a step, not from a slice or from what ran before."""
    import pyarrow as pa
    texts = [" ".join(f"w{(7 * k + j) % 5000}" for j in range(400)) for k in range(500)]
    part = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(texts)], ["id", "text"])
    words = packing.WordIds(PATH)
    whole, edges = words.documents(part.column(1), 1)
    ragged.span_hashes(np.zeros(2 << 20, np.uint8), np.zeros(1, np.int64), np.ones(1, np.int64))  # an operator before, with larger batches
    ragged.forget_powers()
    tracemalloc.start()
    ids, tokens, per = [], [], []
    for a, b, c in words.steps(part, 1):
        ids, tokens, per = ids + a.to_pylist(), [*tokens, b], [*per, c]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == list(range(500)) and np.array_equal(np.concatenate(tokens), whole)
    assert np.array_equal(np.concatenate(per), np.diff(edges))
    assert sum(map(len, texts)) > 3 * packing.STEP_BYTES and peak < 24 << 20  # some 50 MB at once, with powers for 2 MB
    assert ragged._powers["n"] < 1 << 20
