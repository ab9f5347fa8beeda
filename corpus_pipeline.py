"""From raw documents to packed token sequences.

language ID -> quality rules -> n-gram Jaccard join -> substring dedup -> best-fit packing.
Each stage works on all that the one before kept; its result is written as
Parquet and read again, so a lost executor never costs more than one stage.
All stages but the last return the columns of ``documents``, untouched but for the
cleaned ``text`` and its ``n_chars``.

Cases: further columns pass through whatever their names, since the operators see
the input's columns under reserved names only; documents with null text go in the
first stage (no letter, no language); rows without an id stay until they are packed;
rows that repeat an id share its fate; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveforge.llm import jaccard_join, language_id, packing, quality_rules, substring_dedup
from waveforge.llm.shared import drop_folders, materialize, new_folder, scratch


def _reserved(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns renamed to ``input_0``, ``input_1`` ..., which no operator's column is called; and the new names."""
    names = {c: f"input_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _restored(rows: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*names.values()).toDF(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or with no clear language go."""
    rows, c = _reserved(docs)
    train = rows.where(~language_id.held_out(c["doc_id"]))
    dictionaries = language_id.train_dictionaries(train, c["doc_id"], c["text"], c["lang"])
    return _restored(language_id.identify(rows, dictionaries, c["doc_id"], c["text"]).where(~F.col("rejected")), docs, c)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from the texts; documents that fail, or lose too much, go."""
    rows, c = _reserved(docs)
    checked = quality_rules.quality(rows, c["text"]).select(*c.values(), "clean_text", "kept")
    # a document that goes leaves a row of nulls in the written table, no text; the filter stands behind the write, else it would repeat the rules
    checked = checked.select(*(F.when(F.col("kept"), F.col("clean_text" if x == c["text"] else x)).alias(x) for x in c.values()), "kept")
    kept = materialize(checked, "cleaned").where("kept")
    return _restored(kept.withColumn(c["n_chars"], F.length(c["text"]).cast(docs.schema["n_chars"].dataType)), docs, c)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest id stays."""
    rows, c = _reserved(docs)
    return _restored(jaccard_join.keep_one(rows, k=5, percent=75, id_col=c["doc_id"], text_col=c["text"]), docs, c)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go from the later ones; documents without a word left go."""
    rows, c = _reserved(docs)
    found = substring_dedup.passages(rows, id_col=c["doc_id"], text_col=c["text"])
    left = substring_dedup.remove_passages(rows, found, id_col=c["doc_id"], text_col=c["text"])
    return _restored(left.withColumn(c["n_chars"], F.length(c["text"]).cast(docs.schema["n_chars"].dataType)), docs, c)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, placed in as few sequences as the packing can."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", clean_lines),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express compression or tokenizing; tests/llm/test_pipeline.py checks each stage and the chain.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        path = new_folder(spark, name)
        with scratch(spark):  # what the stage wrote on its way goes when its result is there, and so does the result before
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_folders(spark, [before])
        before = path
