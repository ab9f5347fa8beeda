"""The thin ``opN_<name>`` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, embedding_dedup, jaccard_join, language_id, lexical_search, license_scan, merkle, packing, quality_rules, sstable, substring_dedup, token_counts, vector_packing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_sorted_string_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return sstable.read_shards(spark, manifest)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.spans_by_document(substring_dedup.passages(_table(spark, sf_dir, "documents")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    dictionaries = language_id.train_dictionaries(docs.where(~language_id.held_out()))
    found = language_id.identify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), k=5, percent=75)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = quality_rules.quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return checked.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.bpe_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, max_segments=64, end_id=1)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(merkle.leaves(_table(spark, sf_dir, "documents")), fanout=8, levels=3).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_sorted_string_table, op3_substring_dedup, op4_language_id, op5_token_counts, op6_license_scan, op7_jaccard_join, op8_quality_rules, op9_best_fit_packing, op10_bpe_tree, op11_lexical_search, op12_vector_packing, op13_merkle_manifest)}
ORACLE_SQL: dict[str, str] = {"op6_license_scan": license_scan.oracle_sql(), "op8_quality_rules": quality_rules.oracle_sql(), "op11_lexical_search": lexical_search.oracle_sql(), "op13_merkle_manifest": merkle.oracle_sql()}
