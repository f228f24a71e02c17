import hashlib
import math
import random

import numpy as np
import pytest

from fleetwatch.llm import vector_codes
from fleetwatch.llm.gnat import Gnat
from fleetwatch.llm.queries import op12_vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def _nearest(part, book):
    return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))


def _expected(rows, parts=16, entries=64):
    """(vec_id, label, code, error, label_error, digest) by the definition, in Python's whole numbers."""
    rows = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    step = max(1, -(-max((len(r[1]) for r in rows), default=0) // parts))
    whole = [[(int(x) * 256 if abs(x) > 2**50 else math.floor(256 * x)) for x in v] + [0] * (parts * step - len(v)) for _, v, _ in rows]
    cut = [[w[p * step: (p + 1) * step] for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    for _ in range(2):
        for p in range(parts):
            mine = {}
            for c in cut:
                mine.setdefault(_nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(mine[k]) for x in zip(*mine[k], strict=True)] if k in mine else e for k, e in enumerate(books[p])]
    found = [[_nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    top, labels = (1 << 63) - 1, {}
    errors = [min(sum(d for d, _ in f), top) for f in found]
    for (_, _, lab), e in zip(rows, errors, strict=True):
        labels[lab] = labels.get(lab, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, min(labels[lab], top)) for (i, _, lab), f, e in zip(rows, found, errors, strict=True)), key=str), digest


def _compare(df, rows):
    got, books = vector_codes.errors_by_label(df)
    want, digest = _expected(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert not want or books.digest() == digest


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want, digest = _expected(rows)
    got = op12_vector_codes(spark, folder).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_nulls_ties_repeated_rows_and_other_lengths(docs):
    rnd = random.Random(2)
    grid = lambda n: [rnd.choice([-0.5, -0.01, 0.0, 0.25, 1.0]) for _ in range(n)]
    rows = [(rnd.choice([None, *range(120)]), grid(rnd.choice([32, 32, 32, 20, 33, 0])), rnd.choice([None, 1, 2])) for _ in range(200)]
    rows += rows[:40] + [(5, None, 1), (6, [1.0, None], 1), (7, [float("nan")] * 32, 1), (8, [float("inf")] * 32, None), (9, [float("-inf")], 2)]
    _compare(docs([(*r, "x") for r in rows], f"{SCHEMA}, vector string").repartition(5), rows)


@pytest.mark.parametrize("size", [1e6, 1e12, 1e30, 1.7e308])
def test_large_components_are_exact(docs, size):
    rnd = random.Random(3)
    rows = [(k, [rnd.uniform(-size, size) if rnd.random() < 0.5 else rnd.uniform(-1, 1) for _ in range(32)], k % 3) for k in range(90)]
    _compare(docs(rows, SCHEMA).repartition(4), rows)


def test_few_rows_and_empty_table(docs):
    _compare(docs([(3, [0.1] * 16, None), (1, [0.2] * 16, None)], SCHEMA), [(3, [0.1] * 16, None), (1, [0.2] * 16, None)])
    _compare(docs([], SCHEMA), [])


def test_decoded_vectors_are_near(docs):
    rnd = random.Random(4)
    df = docs([(k, [rnd.gauss(0, 0.1) for _ in range(64)], 0) for k in range(300)], SCHEMA)
    books = vector_codes.learn(df)
    back = vector_codes.decode(vector_codes.encode(df, books, vec_id="vec_id"), books).join(df, "vec_id").collect()
    floors = [[math.floor(256 * x) / 256 for x in r.embedding] for r in back]
    assert all(round(sum((256 * (a - b)) ** 2 for a, b in zip(f, r.decoded, strict=True))) == r.error for f, r in zip(floors, back, strict=True))


@pytest.mark.parametrize("top", [2, 50, 1 << 20, 1 << 40])
def test_tree_finds_the_lowest_of_the_nearest(top):
    rnd = np.random.default_rng(top)
    for n in (1, 7, 64, 200):
        entries, queries = rnd.integers(-top, top, (n, 4)), rnd.integers(-top, top, (300, 4))
        tree = Gnat(entries)
        index, distance = tree.nearest(queries)
        away = ((queries.astype(object)[:, None] - entries.astype(object)[None]) ** 2).sum(axis=2)
        best = away.min(axis=1)
        assert (distance == best).all() and (index == (away == best[:, None]).argmax(axis=1)).all()


def test_tree_rules_out_subtrees():
    rnd = np.random.default_rng(1)
    centres = rnd.integers(-4000, 4000, (8, 4))
    tree = Gnat((centres[:, None] + rnd.integers(-40, 40, (8, 25, 4))).reshape(-1, 4))
    tree.nearest((centres[rnd.integers(0, 8, 1000)] + rnd.integers(-40, 40, (1000, 4))))
    assert tree.visited < 1000 * 200 / 3
