"""Seeded samples, shuffles and splits. Every choice is an exact rank of a hash, so reruns agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.operators.layout import hash_rank, rank_labels, seeded_hash


def sample_per_type(
    df: DataFrame, max_rows: int = 10000, seed: int = 42, key: str = "comment_id", by: str = "good_type"
) -> DataFrame:
    """Up to ``max_rows`` rows per category (null categories drop out)."""
    return hash_rank(df.where(F.col(by).isNotNull()), key, [by], seed, first=max_rows).drop("hash_rank", "group_rows")


def shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in seeded order (a range-partitioned sort)."""
    return df.orderBy(seeded_hash(seed, key), key)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` seeded random rows; the limit is taken per partition first."""
    return shuffle(df, key, seed).limit(n)


def first_products(df: DataFrame, n: int = 5, key: str = "product_sku") -> DataFrame:
    """Trial mode: the first ``n`` products by key."""
    return df.orderBy(key).limit(n)


def fixed_split(df: DataFrame, n_train: int, key: str = "product_sku", seed: int = 42) -> DataFrame:
    """Add ``split``: ``n_train`` seeded random rows are ``train``, the rest ``val``."""
    return rank_labels(df, key, (), lambda g: g.withColumn("_cut0", F.lit(n_train)), ["train"], "val", "split", seed)


def downsample_category(
    products: DataFrame, category: str, ratio: float, seed: int = 42, key: str = "product_sku", by: str = "good_type"
) -> DataFrame:
    """Drop floor(n / ratio) products of one category; all other rows stay.

    ``products`` may have several rows per product; a product is dropped as a whole.
    """
    skus = products.where(F.col(by) == category).select(key).distinct()
    ranked = hash_rank(skus, key, (), seed)
    dropped = ranked.where(F.col("hash_rank") <= F.floor(F.col("group_rows") / F.lit(ratio))).select(key)
    return products.join(dropped, key, "left_anti")


def _quotas(strata: DataFrame, by: str, size: Column, total: int, out: str) -> DataFrame:
    """Largest-remainder shares of ``total`` over the strata in proportion to ``size``; ties by stratum name."""
    everything = W.partitionBy()
    share = F.lit(total) * size / F.sum(size).over(everything)
    ranked = strata.withColumn("_floor", F.floor(share)).withColumn("_rest", F.round(share - F.col("_floor"), 9))
    left = F.lit(total) - F.sum("_floor").over(everything)
    extra = F.when(F.row_number().over(W.orderBy(F.col("_rest").desc(), by)) <= left, 1).otherwise(0)
    return ranked.withColumn(out, (F.col("_floor") + extra).cast("long")).drop("_floor", "_rest")


def stratified_split(
    df: DataFrame,
    key: str = "product_sku",
    strat_col: str = "good_type",
    test: float = 0.1,
    val: float = 0.1,
    seed: int = 42,
    min_stratum: int = 3,
    min_rows: int = 10,
) -> DataFrame:
    """Add ``split`` (train, val, test), stratified by ``strat_col``; one row per ``key``.

    Categories with fewer than ``min_stratum`` rows (and rows without one) are all train. If fewer than ``min_rows`` rows or
    fewer than two categories are left, everything is split at random without strata. Only the per-category
    count table is ranked as a whole; rows are labelled block by block.
    """
    def cuts(groups: DataFrame) -> DataFrame:
        sizes = groups.where(F.col(strat_col).isNotNull() & (F.col("group_rows") >= min_stratum)).withColumnRenamed("group_rows", "_size")
        ok_rows, ok_types = sizes.agg(F.sum("_size"), F.count(F.lit(1))).first()
        if (ok_rows or 0) < min_rows or ok_types < 2:
            raise _TooFew
        n_test = math.ceil(test * ok_rows)
        n_val = math.ceil(val / (1.0 - test) * (ok_rows - n_test))
        counts = _quotas(sizes, strat_col, F.col("_size"), n_test, "_test")
        counts = _quotas(counts, strat_col, F.col("_size") - F.col("_test"), n_val, "_val")
        return counts.select(strat_col, F.col("_test").alias("_cut0"), (F.col("_test") + F.col("_val")).alias("_cut1"))

    try:
        return rank_labels(df, key, [strat_col], cuts, ["test", "val"], "train", "split", seed)
    except _TooFew:
        return _plain_split(df, key, test, val, seed)


class _TooFew(Exception):
    """Too few rows or categories for strata."""


def _plain_split(df: DataFrame, key: str, test: float, val: float, seed: int) -> DataFrame:
    def cuts(groups: DataFrame) -> DataFrame:
        held = F.ceil(F.lit(test + val) * F.col("group_rows"))
        return groups.withColumns({"_cut0": F.ceil(F.lit(test / (test + val)) * held), "_cut1": held})

    return rank_labels(df, key, (), cuts, ["test", "val"], "train", "split", seed)
