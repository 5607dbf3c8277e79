"""A corpus from raw documents to packed training sequences: four stages, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagweave.llm import jaccard, packing, pieces, quality, toxicity
from tagweave.llm.common import stored, table
from tagweave.llm.queries import WORD_FILE


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, learnt from the labelled ones among them, does not reject."""
    return toxicity.drop_toxic(docs, toxicity.train_toxicity(docs, table(spark, sf_dir, "labels")))


def quality_kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labelled ones among them, does not reject."""
    return quality.keep_quality(docs, quality.train_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of similar ones."""
    return jaccard.one_per_class(docs, stored(jaccard.jaccard_classes(docs), "near-classes"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return packing.pack_documents(docs, lambda: pieces.word_encoder(WORD_FILE))


STAGES = [
    ("toxicity", toxic_out),
    ("quality_classifier", quality_kept),
    ("ngram_jaccard_join", near_duplicates_out),
    ("best_fit_packing", packed),
]

# Trained classifiers and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
