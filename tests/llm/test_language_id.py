import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fleetwatch.llm import language_id, ragged
from fleetwatch.llm.common import fold

from .conftest import ODD


def test_held_out_accuracy(small):
    held = fold(small["doc_id"], 4) == 2
    filters = language_id.learn(small.where(~held))
    got = language_id.predictions(small, filters, "text", doc_id=small["doc_id"], lang=small["lang"], held=held).collect()
    assert len(got) == small.count()
    out = [r for r in got if r.held]
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95
    assert all(0 <= r.lang_score <= 1 for r in got)


def test_odd_texts_null_labels_and_clashing_columns(docs, small):
    filters = language_id.learn(small.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))))
    df = docs([(k, t, "c") for k, t in enumerate(ODD)], "doc_id long, text string, doc string")
    got = {r.doc_id: r for r in language_id.predictions(df, filters, "text", doc_id=df["doc_id"]).collect()}
    for k, t in enumerate(ODD):
        assert (got[k].lang_pred == "und") == (not any(c.isalpha() for c in t or "")), t
        assert got[k].lang_pred != "und" or got[k].lang_score == 0
    kept = language_id.keep_known(df, filters, min_score=0.0)
    assert kept.columns == df.columns and kept.count() == sum(r.lang_pred != "und" for r in got.values())


def test_nothing_to_learn(docs):
    empty = docs([], "doc_id long, text string, lang string")
    filters = language_id.learn(empty)
    assert filters.languages == []
    df = docs([(1, "some words", "en")], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language_id.predictions(df, filters, "text", doc_id=df["doc_id"]).collect()] == [(1, "und", 0.0)]
    assert language_id.keep_known(empty, filters).count() == 0


def test_filter_has_no_false_negatives_and_many_languages(docs):
    rows = [(k, f"{chr(97 + k // 26)}{chr(97 + k % 26)}qx" * 3, f"l{k:03d}") for k in range(90)]
    filters = language_id.learn(docs(rows, "doc_id long, text string, lang string"))
    assert len(filters.languages) == 90 and filters.masks.shape[1] == 2
    best, score = filters.predict(pa.array([t for _, t, _ in rows]))
    assert [filters.languages[b] for b in best] == [lang for _, _, lang in rows] and np.all(score > 0.9)


def test_without_labels_all_texts_with_letters_are_kept(docs):
    rows = [(1, "some words", None), (2, None, None), (3, "", None), (4, "12345 !!", None), (5, "日本語", None), (6, "7 a", None)]
    df = docs(rows, "doc_id long, text string, lang string")
    kept = language_id.keep_known(df, language_id.learn(df))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 5, 6]


def _grams(text):
    """The n-grams of a text in plain Python, one by one."""
    lower, letter = language_id.letter_tables()
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
        codes = [0, *(int(lower[ord(c)]) for c in word), 0]
        for n in language_id.SIZES:
            for at in range(len(codes) - n + 1):
                if all(codes[at + 1: at + n - 1]):
                    yield tuple(codes[at: at + n])


def _places(gram, rows):
    h = ragged.span_hashes(np.array(gram, np.uint32), np.array([0]), np.array([len(gram)]))
    return [int(p[0]) for p in language_id._positions(h, rows)]


def test_filters_and_scores_equal_brute_force(docs):
    rng = np.random.default_rng(3)
    letters = {"aa": "abcdeé", "bb": "defghß", "cc": "abxyz日"}
    rows = []
    for k in range(120):
        lang = ["aa", "bb", "cc"][k % 3]
        words = ["".join(rng.choice(list(letters[lang] + "-A"), rng.integers(1, 9))) for _ in range(12)]
        rows.append((k, " ".join(words) + rng.choice(["", "!", " 12"]), lang if k % 10 else None))
    rows += [(200, rows[1][1], rows[1][2]), (201, None, "aa"), (202, "", "bb")]
    df = docs(rows, "doc_id long, text string, lang string")
    positions = 1 << 14
    filters = language_id.learn(df, positions=positions)
    seen = {}
    for _, text, lang in rows:
        if lang is not None and text is not None:
            seen.setdefault(lang, Counter()).update(_grams(text))
    rates = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in seen.items()}
    masks = [0] * positions
    for lang, own in rates.items():
        for g, r in own.items():
            if r >= 0.2 * max(o.get(g, 0.0) for o in rates.values()):
                for p in _places(g, positions):
                    masks[p] |= 1 << filters.languages.index(lang)
    assert filters.masks[:, 0].tolist() == masks
    chance = [(sum(m >> k & 1 for m in masks) / positions) ** 3 for k in range(3)]
    got = {r.doc_id: r for r in language_id.predictions(df, filters, "text", doc_id=df["doc_id"]).collect()}
    for k, text, _ in rows:
        grams = list(_grams(text))
        hits = [sum(all(masks[p] >> c & 1 for p in _places(g, positions)) for g in grams) for c in range(3)]
        free = [max(0.0, (h - len(grams) * q) / (1 - q)) for h, q in zip(hits, chance, strict=True)]
        if not any(c.isalpha() for c in text or ""):
            assert (got[k].lang_pred, got[k].lang_score) == ("und", 0.0)
        else:
            assert got[k].lang_pred == filters.languages[free.index(max(free))]
            assert abs(got[k].lang_score - min(1.0, max(free) / max(1, len(grams)))) < 1e-12
