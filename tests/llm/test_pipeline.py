import os
from collections import defaultdict

import public_tokenizers
from pyspark.sql import Row
from tokenizers import Tokenizer

import corpus_pipeline
from fleetwatch.llm import language_id, pii

from .conftest import ODD, SMALL, prose
from .test_near_dedup import _edited, _expected


def _brute(spark, rows):
    """The ids of the documents that come through, with their texts, stage by stage."""
    df = spark.createDataFrame(rows)
    filters = language_id.learn(df)
    known = {r.doc_id for r in language_id.predictions(df, filters, "text", doc_id=df["doc_id"]).where("lang_pred <> 'und' AND lang_score >= 0.3").collect()}
    kept = {}
    for r in sorted((r for r in rows if r.doc_id in known), key=lambda r: r.doc_id):
        kept[r.text] = r.doc_id
    texts = sorted((i, t) for t, i in kept.items())
    near = [max(texts[k][0] for k in g) for g in _expected([t for _, t in texts])]
    names = pii.Pseudonyms(pii.session_key(spark))
    return {i: names.replace(t)[0] for i, t in texts if i in set(near)}


def _table(spark, path, rows):
    spark.createDataFrame(rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_against_brute_force(spark, tmp_path):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()[:120]
    base = rows[5].text
    extra = [base, base, _edited(base, 1, 3), None, "", "12345 !!", prose(30) + " 4111111111111111 a@b.example.com"] + [t for t in ODD if t and len(t) < 500]
    rows += [Row(doc_id=10_000 + k, text=t, lang="en", source=None, n_chars=len(t or "")) for k, t in enumerate(extra)]
    path = _table(spark, tmp_path, rows)
    want = _brute(spark, rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns, name
    got = {r.doc_id: r for r in docs.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for i, r in got.items() if i >= 10_000)
    assert 10_003 not in got and 10_005 not in got and len(set(got) & {rows[5].doc_id, 10_000, 10_001, 10_002}) == 1
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    parts = defaultdict(int)
    for r in corpus_pipeline.run(spark, path).collect():
        parts[r.doc_id] += r.length
        assert r.doc_tokens == len(library.encode(want[r.doc_id], add_special_tokens=False).ids) + 1
    assert {i: n for i, n in parts.items()} == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}


def test_empty_table(spark, tmp_path):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_are_the_five_asked_for():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "pii", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
