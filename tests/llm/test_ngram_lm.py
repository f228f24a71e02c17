import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fleetwatch.llm import ngram_lm
from fleetwatch.llm.common import fold
from fleetwatch.llm.elias_fano import EliasFano

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _brute(rows, m):
    docs = [(i, [*WORD.findall((t or "").translate(LOW)), None]) for i, t in rows]
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1 for i, _ in docs]
    c, b, starts = Counter(), Counter(), 0
    for (_, w), h in zip(docs, held, strict=True):
        if not h:
            starts += 1
            c.update(w)
            b.update(zip([0, *w], w, strict=False))
    n, v = sum(c.values()), len(c)
    n1, n2 = (sum(x == k for x in c.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2) if n1 else 0
    total = dict(c) | {0: starts}
    p1 = lambda w: (c[w] - d) / n if c[w] else d * v / n
    out = []
    for (i, w), h in zip(docs, held, strict=True):
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        score = sum(math.log10((b[u, x] + m * p1(x)) / (total.get(u, 0) + m)) for u, x in zip([0, *w], w, strict=False))
        out.append((i, h, len(w), sum(c[x] > 0 for x in w), n, base, score))
    return out


def _same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and abs(g[6] - w[6]) <= 3e-4 * w[2]


def test_scores_against_brute_force(docs, small, monkeypatch):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()] + [(5000 + k, t) for k, t in enumerate(ODD)] + [(None, "the end"), (7, "the"), (7, "the")]
    df = docs(rows).repartition(3)
    _same(ngram_lm.score(df, fold(df["doc_id"], 5) == 1).collect(), _brute(rows, 200.0))


def test_model_beats_the_base_on_held_out_texts(small):
    got = [r for r in ngram_lm.score(small, fold(small["doc_id"], 5) == 1).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_hot_context_is_dealt_out(docs):
    rows = [(k, " ".join(f"the w{k * 40 + j}" for j in range(40))) for k in range(60)]
    df = docs(rows).repartition(2)
    _same(ngram_lm.score(df, fold(df["doc_id"], 5) == 1).collect(), _brute(rows, 200.0))


def test_no_training_text_and_empty_table(docs):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    df = docs([(held, "a b"), (held, None)])
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_lm.score(df, fold(df["doc_id"], 5) == 1).collect()) == [(1, 0, 0, 0, 0), (3, 0, 0, 0, 0)]
    empty = docs([])
    assert ngram_lm.score(empty, fold(empty["doc_id"], 5) == 1).count() == 0


def test_probabilities_sum_to_one():
    contexts, words = np.array([10, 20], np.uint64), np.array([1, 2, 3], np.uint64)
    priors = {1: 0.5, 2: 0.3, 3: 0.1, 4: 0.1}
    counts = {(10, 1): 4.0, (10, 3): 2.0, (20, 2): 1.0}
    pairs = np.array(sorted((10, 20).index(c) * 3 + w - 1 for c, w in counts), np.uint64)
    import tempfile
    with tempfile.TemporaryDirectory() as folder:
        trie = ngram_lm.Trie(folder, contexts, np.array([6.0, 1.0]), words, pairs, np.array([4.0, 2.0, 1.0]), np.array([0.5, 0.1, 0.3]), 2.0)
        for c, n in ((10, 6.0), (20, 1.0), (30, 0.0)):
            w = np.array([1, 2, 3, 4], np.uint64)
            prior = ngram_lm.log_code(np.array([priors[k] for k in w.tolist()]))
            codes = trie.codes(np.full(4, c, np.uint64), w, prior, ngram_lm.log_code(np.full(4, 2.0 / (n + 2.0))))
            assert (10.0 ** (-ngram_lm.STEP * codes)).sum() == pytest.approx(1, abs=1e-3)


def test_elias_fano_sequences():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 0), (1, 2 ** 63), (5, 10), (1000, 10 ** 4), (20_000, 2 ** 64 - 1), (3000, 3000)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        e = EliasFano.of(v)
        assert (e[np.arange(n)] == v).all()
        q = np.concatenate([v, rng.integers(0, top, 500, dtype=np.uint64, endpoint=True), np.array([0, top, 2 ** 64 - 1], np.uint64)])
        assert (e.successor(q) == np.searchsorted(v, q, "left")).all()
        assert ((e.find(q) >= 0) == np.isin(q, v)).all()


def test_packed_numbers():
    arrays = [np.arange(5), np.zeros(0, np.int64), np.array([2 ** 64 - 1, 0], np.uint64), np.zeros(3, np.uint8)]
    assert [a.tolist() for a in ngram_lm.unpack(ngram_lm.pack(*arrays))] == [a.tolist() for a in arrays]
