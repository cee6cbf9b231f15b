"""From raw documents to packed training sequences: language ID, quality rules, near duplicates, packing.

Each stage but the last returns the columns of documents, extra ones too, whatever their names. Null and empty texts have no
language and are rejected by the first stage (kept, where no row has a language to learn from, and then rejected by the
second for want of words). Rows without an id are judged like others; of a group of copies the row with the smallest id stays,
and of rows that repeat it all stay, like rows without an id. Ties: a probability or cosine of just the threshold is kept.
Texts of any length are read whole. Empty tables: no rows; without labels the base rules alone decide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import jaccard_join, language_id, packing, quality
from quadrille.llm.common import stored, table


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the language model, fitted on those not held out, rejects."""
    return language_id.accepted(docs, language_id.fit_fold(docs))


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base rules or the model, fitted on the labelled ones left, reject."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of near duplicates."""
    return jaccard_join.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return packing.pack_documents(docs)


STAGES = [("language_id", by_language), ("quality_rules", by_quality), ("ngram_jaccard_join", without_copies), ("best_fit_packing", packed)]
#: Trained models and a tokenizer: SQL can't express the stages. The tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
