"""The training-data pipeline: documents through the stages, each written as Parquet and
read back as the next one's input.

``run(spark, sf_dir)`` applies them to the ``documents`` table.  Every stage but the
last returns the columns of ``documents``; an empty table passes through as empty.  As a
stage's result is written before the next stage begins, the tables behind it are
deleted then.
"""
from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetwatch.llm import exact_dedup, language_id, near_dedup, packing, pii
from fleetwatch.llm.common import documents
from fleetwatch.session import materialize, recorded, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables behind the result of the last stage, by application.
_behind: dict[str, list[str]] = {}


def _stage(function: Stage) -> Stage:
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        release(spark, _behind.pop(app, []))
        with recorded() as tables:
            result = function(spark, docs, sf_dir)
        _behind[app] = tables
        return result

    return run_stage



@_stage
def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts that are null, have no letter or look
    like no language go.  The languages are those of the input's own labels; without any
    label all documents with a letter stay."""
    return language_id.keep_known(docs, language_id.learn(docs))


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the largest doc_id stays."""
    return near_dedup.deduplicate(docs)


@_stage
def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses replaced in format; n_chars stays right, as
    pseudonyms are as long as what they replace."""
    return pii.pseudonymise(docs, key=pii.session_key(spark), spans=False)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", pseudonyms),
    ("packing", pack_sequences),
]

#: Language ID, edit-similarity classes and tokenization have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        with recorded() as tables:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, before)
        before = tables[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
