"""Registered queries of this subpackage: ``(spark, sf_dir) -> DataFrame`` over whole tables."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe_counts, conversations, exact_dedup, language_id, line_rules, near_dedup, ngram_lm, packing, pieces, pii, simhash_dedup, vector_codes, warc_bundles
from .common import documents, fold, pages


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(documents(spark, sf_dir), key=pii.session_key(spark))
    return found.select("doc_id", "text", F.size("pii_spans").alias("n_replaced"), "pii_spans")


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return ngram_lm.score(docs, fold(docs["doc_id"], 5) == 1)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(documents(spark, sf_dir))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = pages(spark, sf_dir)
    kind = table.schema["page_id"].dataType
    back = warc_bundles.read(warc_bundles.write(table))
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = fold(docs["doc_id"], 4) == 2
    found = language_id.predictions(docs, language_id.learn(docs.where(~held)), "text", doc_id=docs["doc_id"], held_out=held)
    return found.withColumnRenamed("lang_score", "score")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    hurt = conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversations.repair(hurt, present=hurt["present"])


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.errors_by_label(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.withColumn("codebooks_sha256", F.lit(books.digest()))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.classes(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (op1_pii, op2_ngram_lm, op3_packing, op4_line_rules, op5_warc, op6_near_dedup, op7_language_id, op8_pieces, op9_exact_dedup, op10_token_counts, op11_conversations, op12_vector_codes, op13_simhash)
}

ORACLE: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
        SELECT page_id, payload_bytes, sha256(payload) AS payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
               doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))""",
}
