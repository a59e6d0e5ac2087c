"""A training-data pipeline over documents: toxicity, quality rules, near and passage duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqprep.llm import compact_windows, line_rules, packing, simhash, toxicity
from seqprep.llm.common import remainder, table, written
from seqprep.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword model, fitted on the labelled ones, does not call toxic."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=remainder(F.col("doc_id"), 4) != 2)
    return toxicity.keep_clean(docs, "text", model)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without lines that are boilerplate of their source."""
    return _counted(line_rules.clean_documents(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that another one has already."""
    return _counted(compact_windows.remove_passages(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each document's token ids placed in sequences."""
    return packing.pack_documents(docs, "doc_id", "text", tokenizer(), keep_ids=True)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", apply_rules),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("best_fit_packing", pack),
]

# trained models and fingerprints are beyond SQL; a test checks the packed ids of a small run
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
