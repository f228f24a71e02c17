import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetwatch.llm import simhash_dedup
from fleetwatch.llm.bk_trees import Forest, joined
from fleetwatch.llm.queries import op13_simhash

from .conftest import ODD, prose


def _print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k: k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def _components(prints, radius=4):
    """Smallest place of the component of each print, by all pairs."""
    p = np.array(prints, np.uint64)
    label = np.arange(len(p))
    near = np.bitwise_count(p[:, None] ^ p[None]) <= radius
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


def _expected(rows):
    prints = [_print(t) for _, t in rows]
    label = _components(prints)
    least = {}
    for k, (i, _) in zip(label, rows, strict=True):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return sorted(((i, f"{p:016x}", least.get(k)) for (i, _), p, k in zip(rows, prints, label, strict=True)), key=str)


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op13_simhash(spark, folder).collect()), key=str) == _expected(rows)


def test_odd_texts_nulls_and_repeated_rows(docs):
    long = prose(3000, 1)
    words = long.split()
    rows = [(k, t) for k, t in enumerate(ODD)] * 2 + [(None, "A b C d e"), (None, "a B c D\te"), (77, "a b c d e f"), (None, "only without an id here")]
    rows += [(200 + k, " ".join(words[:50 * k] + ["changed"] + words[50 * k:])) for k in range(30)] + [(300, long.upper()), (301, "\n".join(words))]
    got = simhash_dedup.classes(docs([(*r, "x") for r in rows], "doc_id long, text string, print string").repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=str) == _expected(rows)
    assert len({r.component_id for r in got.where("doc_id >= 200").collect()}) == 1


def test_empty_table(docs):
    assert simhash_dedup.classes(docs([])).count() == 0


def _variants(n, bits, seed, clusters=1):
    rnd = random.Random(seed)
    bases = [rnd.getrandbits(64) for _ in range(clusters)]
    out = set()
    while len(out) < n:
        p = rnd.choice(bases)
        for _ in range(rnd.randrange(bits + 1)):
            p ^= 1 << rnd.randrange(64)
        out.add(p)
    return sorted(out, key=lambda _: rnd.random())


@pytest.mark.parametrize("bits,clusters", [(6, 1), (14, 2), (30, 3)])
@pytest.mark.parametrize("shard", [4096, 40])
def test_dense_and_sparse_clusters_in_shards(spark, bits, clusters, shard):
    prints = _variants(700, bits, bits, clusters)
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    got = {r.node: r.label for r in simhash_dedup.linked(table, shard=shard).collect()}
    label = _components(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    least = {}
    for k, s in zip(label, signed, strict=True):
        least[k] = min(least.get(k, s), s)
    assert [got.get(s, s) for s in signed] == [least[k] for k in label]


@pytest.mark.parametrize("n", [1, 10**6, 10**9, 10**11])
def test_near_prints_share_a_bucket(n):
    rnd, masks = random.Random(n), simhash_dedup._blocks(n, 4)
    for _ in range(500):
        p = rnd.getrandbits(64)
        q = p
        for b in rnd.sample(range(64), 4):
            q ^= 1 << b
        assert any(p & m == q & m for m in masks)
    assert n >> min(m.bit_count() for m in masks) <= simhash_dedup.BUCKET


def test_tree_follows_only_edges_within_the_radius():
    rnd = np.random.default_rng(2)
    prints = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64)
    prints[1::2] = prints[::2] ^ (np.uint64(1) << rnd.integers(0, 64, 1500).astype(np.uint64))
    groups = np.sort(rnd.integers(0, 4, 3000))
    forest = Forest(prints, groups)
    got = {(int(a), int(b)) for q, m in forest.within(prints, groups, 4) for a, b in zip(q, m, strict=True)}
    near = (np.bitwise_count(prints[:, None] ^ prints[None]) <= 4) & (groups[:, None] == groups[None])
    assert got == set(zip(*[x.tolist() for x in np.nonzero(near)], strict=True))
    assert forest.visited < (groups[:, None] == groups[None]).sum() / 3


def test_joined_labels():
    rnd = np.random.default_rng(3)
    a, b = rnd.integers(0, 500, 400), rnd.integers(0, 500, 400)
    label = joined(a, b, 500)
    parent = list(range(500))
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    assert label.tolist() == [root(x) for x in range(500)]


def test_hot_text_over_many_rows(docs):
    rows = [(k, "one and the same text of several words" if k % 3 else prose(30, k)) for k in range(900)]
    got = simhash_dedup.classes(docs(rows).repartition(8)).where(F.col("doc_id") % 3 != 0)
    assert {tuple(r) for r in got.select("fingerprint", "component_id").collect()} == {(f"{_print(rows[1][1]):016x}", 1)}
