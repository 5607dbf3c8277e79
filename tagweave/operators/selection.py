"""From label scores to tags: pooling, priors, allow-lists, thresholds and the final choice.

Scores are a long table (product_sku, good_type, label, prob); it is never pivoted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.functions.numeric import logit, sigmoid
from tagweave.functions.text import strip

DEFAULT_THRESHOLD = 0.35


def max_pool_scores(chunk_scores: DataFrame) -> DataFrame:
    """Best probability over the chunks of a product, combined before the shuffle."""
    return chunk_scores.groupBy("product_sku", "good_type", "label").agg(F.max("prob").alias("prob"))


def join_priors(scores: DataFrame, priors: DataFrame, fallback: bool = True, strip_key: bool = False) -> DataFrame:
    """Add ``prior_logit``: the category's, else (with ``fallback``) the global one, else null.

    Both are left joins from the score table, which is not shuffled as long as Spark measures the priors to be
    small enough to broadcast.
    """
    key = strip("good_type") if strip_key else F.col("good_type")
    own = priors.where(F.col("good_type").isNotNull()).select(
        F.col("good_type").alias("_t"), F.col("label").alias("_l"), F.col("prior_logit").alias("_own")
    )
    out = scores.join(own, (key == F.col("_t")) & (F.col("label") == F.col("_l")), "left").drop("_t", "_l")
    if not fallback:
        return out.withColumnRenamed("_own", "prior_logit")
    overall = priors.where(F.col("good_type").isNull()).select("label", F.col("prior_logit").alias("_all"))
    return out.join(overall, "label", "left").withColumn("prior_logit", F.coalesce("_own", "_all")).drop("_own", "_all")


def blend_prior(
    scores: DataFrame, priors: DataFrame, weight: float = 1.0, fallback: bool = True, strip_key: bool = False
) -> DataFrame:
    """prob -> sigmoid(logit(prob) + weight * prior); unchanged where no prior is known or ``weight`` <= 0."""
    if weight <= 0:
        return scores
    joined = join_priors(scores, priors, fallback, strip_key)
    blended = sigmoid(logit("prob") + F.lit(float(weight)) * F.col("prior_logit"))
    return joined.withColumn(
        "prob", F.when(F.col("prior_logit").isNotNull(), blended).otherwise(F.col("prob"))
    ).drop("prior_logit")


def allowed_mask(scores: DataFrame, allowed: DataFrame) -> DataFrame:
    """Add ``mask``: 1.0 if the label is allowed for the category or the category has no list, else 0.0."""
    pairs = allowed.select(F.col("good_type").alias("_t"), F.col("label").alias("_l")).distinct()
    types = allowed.select(F.col("good_type").alias("_listed")).distinct()
    key = strip("good_type")
    out = scores.join(pairs, (key == F.col("_t")) & (F.col("label") == F.col("_l")), "left").join(
        types, key == F.col("_listed"), "left"
    )
    mask = F.when(F.col("_listed").isNull() | F.col("_l").isNotNull(), 1.0).otherwise(0.0)
    return out.withColumn("mask", mask).drop("_t", "_l", "_listed")


def apply_allow_list(scores: DataFrame, allowed: DataFrame) -> DataFrame:
    return allowed_mask(scores, allowed).withColumn("prob", F.col("prob") * F.col("mask")).drop("mask")


def with_thresholds(scores: DataFrame, thresholds: DataFrame | float, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Add ``threshold`` per label; a number, or a table (label, threshold), ``default`` for labels without a row."""
    if not isinstance(thresholds, DataFrame):
        return scores.withColumn("threshold", F.lit(float(thresholds)))
    per_label = thresholds.where(F.col("label").isNotNull()).select("label", "threshold")
    return scores.join(per_label, "label", "left").withColumn("threshold", F.coalesce("threshold", F.lit(float(default))))


def binarize(scores: DataFrame, thresholds: DataFrame | float, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Add ``passed`` = prob >= threshold."""
    return with_thresholds(scores, thresholds, default).withColumn("passed", F.col("prob") >= F.col("threshold"))


def select_tags(
    scores: DataFrame,
    thresholds: DataFrame | float,
    top_k: int | None = 8,
    min_tags: int = 1,
    mode: str = "passing",
    default: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """Chosen labels per product with their ``rank``; probability ties go to the smaller label.

    ``passing``: labels at or above their threshold, best first, at most ``top_k``; if none passes, the best
    ``min_tags`` labels. ``by_prob``: as above, but a product with more than ``top_k`` passing labels gets its
    ``top_k`` labels by probability, passing or not. A window covers the labels of one product only.
    """
    rows = binarize(scores, thresholds, default)
    order = [F.col("prob").desc(), F.col("label")]
    if mode == "by_prob":
        product = W.partitionBy("product_sku", "good_type")
        rows = rows.withColumn("_n", F.sum(F.col("passed").cast("int")).over(product)).withColumn(
            "rank", F.row_number().over(product.orderBy(*order))
        )
        many = F.lit(False) if top_k is None else F.col("_n") > F.lit(top_k)
        keep = (
            F.when(many, F.col("rank") <= (top_k or 0))
            .when(F.col("_n") == 0, F.col("rank") <= min_tags)
            .otherwise(F.col("passed"))
        )
        return rows.where(keep).select("product_sku", "good_type", "label", "prob", "rank")
    ranked = rows.withColumn(
        "rank", F.row_number().over(W.partitionBy("product_sku", "good_type").orderBy(F.col("passed").desc(), *order))
    )
    if top_k is not None:
        ranked = ranked.where(F.col("rank") <= top_k)
    return ranked.where(F.col("passed") | (F.col("rank") <= min_tags)).select(
        "product_sku", "good_type", "label", "prob", "rank"
    )


def prediction_lists(selected: DataFrame) -> DataFrame:
    """One row per product: ``tags array<struct<tag,score>>`` best first (at most top_k items)."""
    items = F.array_sort(F.collect_list(F.struct("rank", F.col("label").alias("tag"), F.col("prob").alias("score"))))
    return selected.groupBy("product_sku", "good_type").agg(
        F.transform(items, lambda x: F.struct(x["tag"].alias("tag"), x["score"].alias("score"))).alias("tags")
    )


def top_candidates(scores: DataFrame, n: int = 20, positive_only: bool = True) -> DataFrame:
    """The ``n`` most probable labels per product with their rank.

    Ranks are taken over all labels first; labels of probability 0 drop out afterwards (``positive_only``).
    """
    rank = F.row_number().over(W.partitionBy("product_sku", "good_type").orderBy(F.col("prob").desc(), "label"))
    top = scores.withColumn("rank", rank).where(F.col("rank") <= max(1, n))
    return top.where(F.col("prob") > 0) if positive_only else top
