import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from fleetwatch.llm import near_dedup
from fleetwatch.llm.components import components

from .conftest import ODD, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _shingles(text):
    w, seen = WORD.findall(text or ""), Counter()
    out = []
    for k in range(max(1, len(w) - 4) if w else 0):
        s = tuple(w[k: k + 5])
        seen[s] += 1
        out.append((s, seen[s]))
    return out


def _similarity(a, b):
    """By the full table of the longest common subsequence."""
    a, b = _shingles(a), _shingles(b)
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k + 1], row[k])
    return row[-1] / (len(a) + len(b) - row[-1])


def _expected(texts):
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    sets = [set(_shingles(t)) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if not sets[i] and not sets[j] or shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared) and _similarity(texts[i], texts[j]) >= 0.8 - 1e-12:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[root(i)].append(i)
    return sorted(groups.values())


def _found(df):
    groups = defaultdict(list)
    for r in df.collect():
        groups[r.class_id].append(r.doc_id)
        assert r.class_size >= 1
    return sorted(sorted(g) for g in groups.values())


def _edited(text, n, seed):
    rnd, w = random.Random(seed), text.split()
    for _ in range(n):
        k = rnd.randrange(len(w))
        w[k: k + 1] = rnd.choice([[], [f"new{rnd.randrange(99)}"], [w[k], "more"]])
    return " ".join(w)


def test_classes_against_brute_force(docs):
    texts = [t for t in ODD if t is None or len(t) < 1000]
    for k in range(12):
        base = prose(120 + 10 * k, seed=k)
        texts += [base, base] + [_edited(base, n, n + k) for n in (1, 2, 3, 4, 5, 8, 15, 40)]
    passage = prose(60, seed=99)
    texts += [prose(50, seed=200 + k) + " " + passage + " " + prose(40, seed=300 + k) for k in range(25)]  # a shared passage is no copy
    got = _found(near_dedup.classes(docs(list(enumerate(texts))).repartition(4)))
    assert got == _expected(texts)


def test_chain_of_copies_that_the_smallest_member_does_not_reach(docs):
    text, texts = prose(150, seed=5), []
    for k in range(12):
        texts.append(text)
        text = _edited(text, 2, 1000 + k)
    assert _similarity(texts[0], texts[-1]) < 0.8
    assert _found(near_dedup.classes(docs(list(enumerate(texts))))) == _expected(texts)


def test_similarity_sees_order():
    a = prose(200, seed=1)
    w = a.split()
    moved = " ".join(w[100:] + w[:100])
    left, right = pa.array([a, a, a, "x y", None, "same " * 30]), pa.array([a, moved, _edited(a, 3, 4), "x y", "", "same " * 29])
    got = near_dedup.similarities(left, right)
    for x, y, s in zip(left.to_pylist(), right.to_pylist(), got, strict=True):
        assert (s >= 0.8) == (_similarity(x, y) >= 0.8 - 1e-12)
        assert s < 0.8 or s == pytest.approx(_similarity(x, y))


def test_deduplicate_keeps_one_row_with_all_columns(docs):
    base = prose(100, seed=3)
    rows = [(1, base, "a"), (9, _edited(base, 1, 1), "b"), (5, base, "c"), (None, base, "d"), (None, None, "e"), (2, "", "f"), (3, "other text altogether here now", "g"), (9, _edited(base, 1, 1), "b")]
    out = near_dedup.deduplicate(docs(rows, "doc_id long, text string, label string"))
    assert out.columns == ["doc_id", "text", "label"]
    assert sorted(r.label for r in out.collect()) == ["b", "f", "g"]


def test_empty_table(docs):
    assert near_dedup.classes(docs([])).count() == 0 and near_dedup.deduplicate(docs([])).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200}


def test_hot_groups_and_a_shared_passage_over_many_partitions(docs):
    """A third of the rows are copies of one text, another third near copies of one text that
    are not all alike among themselves."""
    base, texts = prose(120, seed=77), []
    for k in range(120):
        texts += [prose(80, seed=78), _edited(base, 1 + k % 5, 2000 + k), prose(20 + k % 40, seed=k) + " " + prose(60, seed=79)]
    assert _found(near_dedup.classes(docs(list(enumerate(texts))).repartition(12))) == _expected(texts)


def _open(docs, texts):
    """Every text as a class of its own, as the exact join sees what is still open."""
    n = [len(_shingles(t)) for t in texts]
    return docs([(k, n[k], k) for k in range(len(texts))], "rep long, n long, label long"), docs(list(enumerate(texts)), "rep long, text string")


@pytest.mark.parametrize("crowded", [0, 3, 32])
def test_open_texts_lose_no_similar_pair(docs, monkeypatch, crowded):
    monkeypatch.setattr(near_dedup, "CROWDED", crowded)
    texts = []
    for k in range(8):
        base = prose(30 + 25 * k, seed=900 + k)
        texts += [base] + [_edited(base, e, 10 * k + e) for e in (1, 2, 3, 4, 6, 9)] + [base + " " + prose(e, seed=e) for e in (2, 5, 9, 20)] + [" ".join(base.split()[e:]) for e in (1, 4, 8)]
    texts = sorted(set(texts))
    alike = {(a, b) for b in range(len(texts)) for a in range(b) if _similarity(texts[a], texts[b]) >= 0.8 - 1e-12}
    found = [(r.a, r.b) for r in near_dedup._open_pairs(*_open(docs, texts)).collect()]
    assert len(alike) > 80 and len(found) == len(set(found)) and alike <= set(found)


def test_texts_of_one_template_do_not_meet_in_pairs(docs):
    """Too unlike each other, but alike in rare shingles: what meets grows in proportion at most."""
    template, met = " ".join(f"t{k}" for k in range(160)), []
    for size in (500, 1000):
        texts = [template + " " + " ".join(f"own{k}x{j}" for j in range(25 + k % 3)) for k in range(size)]
        x, y = near_dedup._sides(near_dedup._prefixes(*_open(docs, texts)))
        assert x.count() >= size  # they do have common shingles in their prefixes
        met.append(x.join(y, ["s", "band"]).count())
    assert met[0] <= 500 and met[1] <= 1000, met


def test_one_class_alone_does_not_meet(docs):
    base = prose(100, seed=6)
    opened, texts = _open(docs, [base] + [_edited(base, 1, k) for k in range(40)])
    x, _ = near_dedup._sides(near_dedup._prefixes(opened.selectExpr("rep", "n", "0L AS label"), texts))
    assert x.count() == 0
