"""Label vocabulary, multi-hot columns and label statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.functions.text import let
from tagweave.operators.products import explode_tags


def label_frequencies(product_tags: DataFrame, key: str = "product_sku") -> DataFrame:
    """Products per tag from distinct (key, tag) pairs, such as ``long_tags`` or an exploded tag union gives.

    The pairs are not made distinct again: that would be a shuffle of the whole table for nothing.
    """
    return product_tags.where(F.col(key).isNotNull()).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def number_labels(labels: DataFrame) -> DataFrame:
    """Add ``label_id``: distinct labels numbered from 0 in code-point order.

    Labels are ranked within their two-character prefix; only the prefix counts are summed up in one place.
    """
    rows = labels.withColumn("_prefix", F.substring("label", 1, 2))
    before = F.sum("_n").over(W.orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1))
    offsets = rows.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n")).select(
        "_prefix", F.coalesce(before, F.lit(0)).alias("_before")
    )
    local = F.row_number().over(W.partitionBy("_prefix").orderBy("label"))
    return (
        rows.join(offsets, "_prefix")
        .withColumn("label_id", (F.col("_before") + local - 1).cast("int"))
        .drop("_prefix", "_before")
    )


def label_vocab(product_tags: DataFrame, min_freq: int = 3, key: str = "product_sku") -> DataFrame:
    """(label, n, label_id): tags of at least ``min_freq`` products, numbered from 0 in code-point order."""
    kept = label_frequencies(product_tags, key).where(F.col("n") >= min_freq)
    return number_labels(kept.withColumnRenamed("tag", "label"))


def apply_label_vocab(
    product_tags: DataFrame, min_freq: int = 3, key: str = "product_sku", split: str = "split"
) -> tuple[DataFrame, DataFrame]:
    """Distinct long (key, split, tag) -> (rows whose tag is in the vocabulary of the train split, vocabulary).

    Products without any vocabulary tag drop out of the long table by themselves.
    """
    vocab = label_vocab(product_tags.where(F.col(split) == "train"), min_freq, key)
    rows = product_tags.join(vocab.select(F.col("label").alias("tag")), "tag", "left_semi")
    return rows, vocab


def with_label_ids(labels: DataFrame, vocab: DataFrame, column: str = "label") -> DataFrame:
    """Attach ``label_id``; labels outside the vocabulary drop out."""
    return labels.join(vocab.select(F.col("label").alias(column), "label_id"), column)


def multi_hot(df: DataFrame, labels: Sequence[str], column: str = "tags", legacy_substring: bool = False) -> DataFrame:
    """One 0/1 column per known label, from an array column; no shuffle.

    ``legacy_substring`` tests whether the label occurs anywhere in the JSON text of the list.
    """
    if legacy_substring:
        text = F.to_json(column)
        return df.withColumns({lab: text.contains(lab).cast("int") for lab in labels})
    return df.withColumns(
        {lab: F.coalesce(F.array_contains(column, lab), F.lit(False)).cast("int") for lab in labels}
    )


def training_pairs(df: DataFrame, text: str = "text", tags: str = "tags") -> DataFrame:
    """(text, tags as JSON list) rows for a trainer."""
    return df.select(F.col(text).alias("text"), F.to_json(tags).alias("tags"))


def multi_hot_vector(column: str, labels: Column) -> Column:
    """0/1 array over a sorted label array (dense form; only on request)."""
    # Bound: inside the function of a label Spark would make the tags anew for every label.
    return let(F.col(column), lambda tags: F.transform(labels, lambda lab: F.array_contains(tags, lab).cast("int")))


def long_tags(
    df: DataFrame, key: str = "product_sku", column: str = "tags", lower: bool = False, carry: Sequence[str] = ()
) -> DataFrame:
    """Delimited tag cells -> distinct (key, columns that the key decides, tag)."""
    return explode_tags(df, [key, *carry], column, lower).distinct()
