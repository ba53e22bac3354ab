"""The queries of the training-data operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, huffman, langid, mtree, pages, pii, pq, quality, simhash, spelling, suffix, tokengroup, vectors
from .common import read, shared_dir


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare(read(spark, sf_dir, "documents", "doc_id", "text"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(read(spark, sf_dir, "documents", "doc_id", "text"), passage=suffix.PASSAGE)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokengroup.components(read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return huffman.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.scaled(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return mtree.top_k(rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), 5)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.scaled(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), "label").withColumn("label", label)
    return pq.mine(rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("anchor_id"), F.col("v").alias("q"), "label"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_decontamination, op2_bpe, op3_main_text, op4_simhash, op5_repeats, op6_quality, op7_jaccard, op8_token_files, op9_language, op10_pii, op11_topk, op12_hard_negatives, op13_spelling]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontam.ORACLE_SQL, "op11_topk": mtree.ORACLE_SQL, "op12_hard_negatives": pq.ORACLE_SQL}
