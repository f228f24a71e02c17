import re
from collections import Counter

import pyarrow as pa

from fleetwatch.llm import line_rules

from .conftest import ODD, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"


def _base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[k: k + 3]) for k in range(len(w) - 2))
    covered = {k + d for k in range(len(w) - 2) if grams[tuple(w[k: k + 3])] > 1 for d in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_base_counts_against_brute_force(docs, small):
    texts = ODD + [r.text for r in small.select("text").collect()] + ["same line\nsame line\n same line\n\n\n#*$%&|<>", "a b c a b c a b"]
    got = {r.doc_id: r for r in line_rules.judge(docs([(k, t, None) for k, t in enumerate(texts)], SCHEMA)).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _base(t), t


def _verdicts(rows, min_docs, max_share, keep_share):
    hosts, lines = Counter(), Counter()
    normal = lambda line: " ".join(re.sub("[0-9]", "0", "".join(c.lower() if c.isascii() else c for c in w)) for w in WORD.findall(line))
    first = {}
    for _, t, h in rows:
        first.setdefault((" ".join(WORD.findall(t or "")), h), t)
    for (_, h), t in first.items():
        hosts[h] += 1
        for line in {normal(x) for x in (t or "").split("\n") if WORD.search(x)}:
            lines[h, line] += 1
    out = {}
    for k, t, h in rows:
        gone = [x for x in (t or "").split("\n") if WORD.search(x) and lines[h, normal(x)] > min_docs and lines[h, normal(x)] > max_share * hosts[h]]
        removed, base = sum(len(WORD.findall(x)) for x in gone), _base(t)
        out[k] = (removed, len(gone), not base[-1] and base[0] - removed >= keep_share * base[0])
    return out


def test_verdicts_against_brute_force(docs):
    rows = []
    for k in range(90):
        host = ["a", "b", None][k % 3]
        lines = [prose(30, seed=k), prose(25, seed=k + 500)]
        if k % 2:
            lines.insert(1, f"Copyright {k:02d} by the   HOST")
        if k % 7 == 0:
            lines = [prose(70, seed=9999), prose(5, seed=k)]  # little is left of these
        rows.append((k, "\n".join(lines), host))
    rows += [(200 + k, rows[1][1], rows[1][2]) for k in range(30)]  # copies of one text count once
    rows += [(300, None, "a"), (301, "", None)]
    df = docs(rows, SCHEMA)
    limits = dict(min_docs=2, max_share=0.1, keep_share=0.5)
    got = {r.doc_id: (r.removed_words, r.removed_lines, r.kept) for r in line_rules.judge(df, **limits).collect()}
    assert got == _verdicts(rows, **limits)
    assert {v[2] for v in got.values()} == {True, False} and got[1][1] == 1
    cleaned = {r.doc_id: r for r in line_rules.clean(df.withColumn("removed", df.doc_id), **limits).collect()}
    assert set(cleaned) == {k for k, v in got.items() if v[2]} and cleaned[1].removed == 1
    assert cleaned[1].text == "\n".join(x for x in rows[1][1].split("\n") if "Copyright" not in x)


def test_empty_table(docs):
    assert line_rules.judge(docs([], SCHEMA)).count() == 0 and line_rules.clean(docs([], SCHEMA)).count() == 0


def test_planted_boilerplate_on_hosts_of_any_size(docs):
    """Host size -> texts with the long line, the passage, the short line; what goes."""
    plants = {10: (4, 3, 3), 500: (21, 25, 41), 5000: (21, 25, 401)}
    long_line, passage, short = "All rights reserved by the publisher of these pages", prose(70, seed=77), "Read more"
    rows = []
    for size, (n_long, n_passage, n_short) in plants.items():
        for k in range(size):
            lines = [prose(30, seed=size * 10_000 + k), prose(30, seed=size * 10_000 + k + 5_000)]
            if k < n_long:
                lines.insert(1, long_line)
            if k >= size - n_passage:
                lines = [passage, prose(20, seed=size * 10_000 + k)]
            if n_long <= k < n_long + n_short:
                lines.append(short)
            if size == 5000 and 1000 <= k < 1400:
                lines.append("Next page")  # 400 of 5000 are not above 8 %
            if size == 5000 and 2000 <= k < 2020:
                lines.append("one line that no more than twenty texts have in common")
            rows.append((size * 10_000 + k, "\n".join(lines), f"host{size}"))
    got = {r.doc_id: (r.removed_words, r.kept) for r in line_rules.judge(docs(rows, SCHEMA)).collect()}
    for size, (n_long, n_passage, n_short) in plants.items():
        for k in range(size):
            want = (0, True)
            if k >= size - n_passage:
                want = (70, False)
            elif k < n_long:
                want = (9, True)
            if n_long <= k < n_long + n_short:
                want = (want[0] + 2, want[1])
            assert got[size * 10_000 + k] == want, (size, k)
