"""Category label statistics, smoothed priors and the frequency baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.functions.numeric import logit


def category_label_stats(truth: DataFrame, products: DataFrame) -> DataFrame:
    """(good_type, label, pos, n): products per category and positives per label; ``good_type`` null = all.

    ``truth`` holds distinct (product_sku, good_type, label), ``products`` distinct (product_sku, good_type).
    A category without positives appears once with a null label. Products without a category count in the total number alone.
    """
    every = products.groupBy("good_type").agg(F.count(F.lit(1)).alias("n"))
    sizes = every.where(F.col("good_type").isNotNull())
    pos = truth.where(F.col("good_type").isNotNull()).groupBy("good_type", "label").agg(F.count(F.lit(1)).alias("pos"))
    by_type = sizes.join(pos, "good_type", "left").select("good_type", "label", "pos", "n")
    total = every.agg(F.sum("n")).scalar()
    overall = pos.groupBy("label").agg(F.sum("pos").alias("pos")).select(
        F.lit(None).cast("string").alias("good_type"), "label", "pos", total.alias("n")
    )
    return by_type.unionByName(overall)


def smoothed_logit(pos: Column, n: Column, alpha: float) -> Column:
    p = (pos + F.lit(alpha)) / (n + F.lit(2.0 * alpha))
    return F.when(n > 0, logit(p)).otherwise(F.lit(0.0))


def vocab_array(vocab: DataFrame) -> Column:
    """The vocabulary as one array value; its size is the label count, not the data size."""
    return vocab.agg(F.array_sort(F.collect_set("label"))).scalar()


def densify(stats: DataFrame, vocab: DataFrame) -> DataFrame:
    """Statistics with a row for every (category, vocabulary label), ``pos`` 0 where none was counted."""
    types = stats.groupBy("good_type").agg(F.max("n").alias("n")).withColumn("_labels", vocab_array(vocab))
    cells = types.select("good_type", "n", F.explode("_labels").alias("label"))
    counted = stats.where(F.col("label").isNotNull()).select(
        F.col("good_type").alias("_t"), F.col("label").alias("_l"), F.col("pos").alias("_pos")
    )
    same = F.col("good_type").eqNullSafe(F.col("_t")) & (F.col("label") == F.col("_l"))
    return cells.join(counted, same, "left").select("good_type", "label", F.coalesce("_pos", F.lit(0)).alias("pos"), "n")


def category_priors(stats: DataFrame, vocab: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Laplace-smoothed prior logits per (category, label) with a global row set (``good_type`` null)."""
    dense = densify(stats, vocab)
    return dense.select("good_type", "label", smoothed_logit(F.col("pos"), F.col("n"), alpha).alias("prior_logit"))


def category_topk(stats: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent labels per category; zero counts fill up, ties go to the smaller label.

    Works on counted (category, label) rows. The row set with a null category serves unknown ones.
    """
    rank = F.row_number().over(W.partitionBy("good_type").orderBy(F.col("pos").desc(), "label"))
    dense = densify(stats, vocab)
    usable = F.sum("pos").over(W.partitionBy("good_type")) > 0
    return (
        dense.withColumn("_usable", usable).withColumn("rank", rank).where((F.col("rank") <= k) & F.col("_usable"))
        .select("good_type", "label", "rank")
    )


def category_topk_baseline(products: DataFrame, stats: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """(product_sku, label) predictions by category frequency, global frequency for categories without counts."""
    top = category_topk(stats, vocab, k)
    lists = top.groupBy("good_type").agg(F.collect_set("label").alias("labels"))
    own = lists.where(F.col("good_type").isNotNull()).withColumnRenamed("good_type", "_t")
    overall = lists.where(F.col("good_type").isNull()).select("labels").scalar()
    routed = products.join(own, F.col("good_type") == F.col("_t"), "left").withColumn(
        "labels", F.coalesce("labels", overall)
    )
    return routed.select("product_sku", "good_type", F.explode("labels").alias("label"))
