import hashlib
from collections import defaultdict

import pytest

from fleetwatch.llm import exact_dedup

from .conftest import ODD


def _expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("limit", [exact_dedup.HELD_BYTES, 20_000])
def test_classes_against_grouping(docs, small, limit):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()] + [(1000 + k, t) for k, t in enumerate(ODD)] * 2 + [(None, "same"), (None, "same"), (7, "same"), (7, "same")]
    got = exact_dedup.classes(docs(rows).repartition(5), limit=limit).collect()
    want, groups = _expected(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)


def test_deduplicate_keeps_whole_rows(docs):
    rows = [(1, "a", "x"), (3, "a", "y"), (2, None, "z"), (4, "", "w"), (None, "b", "v"), (None, "b", "v")]
    out = exact_dedup.deduplicate(docs(rows, "doc_id long, text string, `class_id` string"))
    assert out.columns == ["doc_id", "text", "class_id"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(3, "a", "y"), (4, "", "w"), (None, "b", "v")], key=str)


def test_hot_text_over_many_partitions(docs):
    rows = [(k, "copy" if k % 3 == 0 else f"text {k}") for k in range(3000)]
    got = exact_dedup.classes(docs(rows).repartition(16), limit=2000).collect()
    assert {(r.keep_id, r.group_size) for r in got if r.group_size > 1} == {(2997, 1000)} and sum(r.kept for r in got) == 2001


def test_table_compares_contents_of_equal_hashes():
    table = exact_dedup.ContentTable()
    assert [table.number(5, c) for c in (b"a", b"b", b"a", b"c")] == [0, 1, 0, 2]
    assert [table.number(k, b"%d" % k) for k in range(5000)] == list(range(3, 5003))


def test_empty_table(docs):
    assert exact_dedup.classes(docs([])).count() == 0 and exact_dedup.deduplicate(docs([])).count() == 0
