"""Multi-label metrics, threshold tuning and losses on long tables.

Predictions and truth are (product_sku, label) tables. Truth is gathered to one label set per product, so scores and predictions are
joined by product alone and share one partitioning; everything after that is sums of few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.functions.numeric import logit

NO_POSITIVES_THRESHOLD = 0.35  # fixed value: threshold of a label without positives


def label_sets(truth: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(product_sku, by, true_labels): the distinct true labels of every product as one array."""
    return truth.groupBy("product_sku", *by).agg(F.collect_set("label").alias("true_labels"))


def with_truth(scores: DataFrame, truth: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``y`` (1 for a true pair, else 0) to score or prediction rows.

    Truth comes as one label set per product, so the large side moves by ``product_sku`` alone and not at all if it lies that way
    already. True pairs without a row are not added; counts of them come from the truth table.
    """
    joined = scores.join(label_sets(truth, by), ["product_sku", *by], "left")
    known = F.coalesce(F.array_contains("true_labels", F.col("label")), F.lit(False))
    return joined.withColumn("y", known.cast("int")).drop("true_labels")


def outcomes(pred: DataFrame, truth: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(product_sku, label, p, y) for every pair that is predicted or true."""
    cols = ["product_sku", "label", *by]
    p = pred.select(*cols, F.lit(1).alias("p"), F.lit(0).alias("y"))
    t = truth.select(*cols, F.lit(0).alias("p"), F.lit(1).alias("y"))
    return p.unionByName(t).groupBy(*cols).agg(F.max("p").alias("p"), F.max("y").alias("y"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def label_counts(pred: DataFrame, truth: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """TP, FP and FN per label; a pair counts once however often it is listed."""
    once = pred.select("product_sku", "label", *by).dropDuplicates()
    of_pred = with_truth(once, truth, by).groupBy(*by, "label").agg(F.count(F.lit(1)).alias("_p"), F.sum("y").alias("_tp"))
    of_truth = label_sets(truth, by).select(*by, F.explode("true_labels").alias("label")).groupBy(*by, "label").agg(F.count(F.lit(1)).alias("_t"))
    # Few rows from here on.
    zero = F.lit(0).cast("long")
    both = of_pred.withColumn("_t", zero).unionByName(of_truth.withColumns({"_p": zero, "_tp": zero}))
    sums = both.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("_p", "_tp", "_t")])
    tp = F.col("_tp")
    return sums.select(*by, "label", tp.alias("tp"), (F.col("_p") - tp).alias("fp"), (F.col("_t") - tp).alias("fn"))


def multilabel_metrics(
    pred: DataFrame,
    truth: DataFrame,
    vocab: DataFrame,
    by: Sequence[str] = (),
    products: DataFrame | None = None,
) -> DataFrame:
    """micro precision, recall, F1 and macro F1 over the whole vocabulary (0 for an undefined ratio).

    With ``products`` (one row each, no grouping) also the mean number of predicted tags, from the same counts.
    """
    return summed_counts(label_counts(pred, truth, by), vocab, by, products)


def summed_counts(counts: DataFrame, vocab: DataFrame, by: Sequence[str] = (), products: DataFrame | None = None) -> DataFrame:
    """:func:`multilabel_metrics` from the counts per label."""
    n_labels = vocab.agg(F.count(F.lit(1))).scalar()
    counts = counts.join(vocab.select("label"), "label", "left_semi")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    sums = counts.withColumn("_f1", f1).groupBy(*by).agg(
        F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"),
        F.coalesce(F.sum("fn"), F.lit(0)).alias("fn"),
        F.coalesce(F.sum("_f1"), F.lit(0.0)).alias("_f1"),
    )
    extra = []
    if products is not None:
        n_products = products.agg(F.count(F.lit(1))).scalar()
        extra.append(_ratio(tp + fp, n_products).alias("avg_pred_tags"))
    return sums.select(
        *by,
        _ratio(tp, tp + fp).alias("micro_precision"),
        _ratio(tp, tp + fn).alias("micro_recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"),
        # Labels without any row count with F1 0: divide by the vocabulary size.
        _ratio(F.col("_f1"), n_labels).alias("macro_f1"),
        *extra,
    )


def subset_accuracy(pred: DataFrame, truth: DataFrame, products: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of products whose predicted label set equals the true one; no labels on both sides is equal."""
    wrong = outcomes(pred, truth, by).groupBy("product_sku", *by).agg(F.max(F.abs(F.col("p") - F.col("y"))).alias("_wrong"))
    rows = products.select("product_sku", *by).join(wrong, ["product_sku", *by], "left")
    exact = F.when(F.coalesce("_wrong", F.lit(0)) == 0, 1.0).otherwise(0.0)
    return rows.groupBy(*by).agg(F.avg(exact).alias("subset_accuracy"), F.count(F.lit(1)).alias("n_products"))


def avg_predicted_tags(pred: DataFrame, products: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean number of predicted tags per product; 0 without products."""
    tags = pred.select(*by, F.lit(0).alias("_p"), F.lit(1).alias("_t"))
    rows = products.select(*by, F.lit(1).alias("_p"), F.lit(0).alias("_t")).unionByName(tags)
    return rows.groupBy(*by).agg(_ratio(F.sum("_t"), F.sum("_p")).alias("avg_pred_tags"))


def precision_recall_at_k(scores: DataFrame, truth: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Mean precision@k and recall@k over the products that have truth and scores."""
    k_max = max(ks)
    rank = F.row_number().over(W.partitionBy("product_sku").orderBy(F.col("prob").desc(), "label"))
    top = scores.withColumn("rank", rank).where(F.col("rank") <= k_max).select("product_sku", "label", "rank")
    known = truth.groupBy("product_sku").agg(F.collect_set("label").alias("_true"), F.count(F.lit(1)).alias("_n"))
    hit = F.coalesce(F.array_contains("_true", F.col("label")), F.lit(False))
    # Every product with scores has a first label, so none is lost by looking at the best labels alone.
    rows = top.join(known, "product_sku").groupBy("product_sku").agg(
        F.max("_n").alias("_n"), *[F.sum(F.when(hit & (F.col("rank") <= k), 1).otherwise(0)).alias(f"_h{k}") for k in ks]
    )
    sums = rows.agg(
        *[F.avg(F.col(f"_h{k}") / F.lit(float(k))).alias(f"_p{k}") for k in ks],
        *[F.avg(F.col(f"_h{k}") / F.col("_n")).alias(f"_r{k}") for k in ks],
    )
    items = F.array(
        *[F.struct(F.lit(k).alias("k"), F.col(f"_p{k}").alias("precision"), F.col(f"_r{k}").alias("recall")) for k in ks]
    )
    return sums.select(F.explode(items).alias("_x")).select("_x.*")


# -- tuning ---------------------------------------------------------------------------------------------------


def grid(steps: int, low: float = 0.05, high: float = 0.95) -> list[float]:
    return [float(x) for x in np.linspace(low, high, steps)]


def bucket(prob: Column | str, values: Sequence[float]) -> Column:
    """How many grid values are <= prob: a first guess by division, corrected by exact comparisons."""
    prob = F.col(prob) if isinstance(prob, str) else prob
    low, step, n = values[0], values[1] - values[0], len(values)
    lookup = F.array(*[F.lit(v) for v in values])
    guess = F.greatest(F.least(F.floor((prob - F.lit(low)) / F.lit(step)).cast("int"), F.lit(n - 1)), F.lit(0))
    above = F.when((guess + 1 < n) & (prob >= F.coalesce(F.get(lookup, guess + 1), F.lit(2.0))), 1).otherwise(0)
    below = F.when(prob < F.get(lookup, guess), 1).otherwise(0)
    return guess + 1 + above - below


def score_histogram(scored: DataFrame, steps: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, _b, _n, _y): rows and true rows by how many grid values their probability reaches."""
    return (
        scored.withColumn("_b", bucket("prob", grid(steps)))
        .groupBy(*by, "_b")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("y").alias("_y"))
    )


def f1_curve(hist: DataFrame, positives: DataFrame, steps: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, step, threshold, f1, n_pos): F1 of ``prob >= threshold`` at every grid value, from a histogram.

    Each bucket counts towards all grid values at or below it. ``positives`` has the number of true pairs (by, ``n_pos``), with or
    without a score. Cost: one pass over the scores + steps^2 per group instead of rows * steps.
    """
    zero = F.lit(0).cast("long")
    truth = positives.select(*by, F.lit(0).alias("_b"), zero.alias("_n"), zero.alias("_y"), F.col("n_pos").alias("_t"))
    rows = hist.select(*by, "_b", "_n", "_y", zero.alias("_t")).unionByName(truth)
    # Every bucket reaches step 0; bucket 0 predicts nothing.
    reach = F.explode(F.sequence(F.lit(0), F.greatest(F.col("_b"), F.lit(1)) - 1)).alias("step")
    counted = F.col("_b") > 0
    spread = rows.select(*by, "_b", "_n", "_y", "_t", reach).groupBy(*by, "step").agg(
        F.sum(F.when(counted, F.col("_n")).otherwise(0)).alias("_pred"),
        F.sum(F.when(counted, F.col("_y")).otherwise(0)).alias("_tp"),
        F.sum("_t").alias("_t"),
    )
    pos = F.max("_t").over(W.partitionBy(*by))
    lookup = F.array(*[F.lit(v) for v in grid(steps)])
    return spread.withColumn("_pos", pos).select(
        *by, "step", F.get(lookup, F.col("step")).alias("threshold"),
        _ratio(2 * F.col("_tp"), F.col("_pred") + F.col("_pos")).alias("f1"), F.col("_pos").alias("n_pos"),
    )


def n_positives(truth: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_pos): distinct true pairs."""
    pairs = label_sets(truth).select("product_sku", F.explode("true_labels").alias("label"))
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pos"))


def _best(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    best_first = F.struct(F.col("f1"), -F.col("step"))
    return curve.groupBy(*by).agg(
        F.max_by("threshold", best_first).alias("threshold"), F.max("f1").alias("f1"), F.max("n_pos").alias("n_pos")
    )


def tune_global_threshold(scores: DataFrame, truth: DataFrame, steps: int = 37) -> DataFrame:
    """One row (threshold, f1): best micro F1 on the grid, the lowest threshold on ties; the default without any pair."""
    return global_threshold(score_histogram(with_truth(scores, truth), steps), n_positives(truth), steps)


def global_threshold(hist: DataFrame, positives: DataFrame, steps: int) -> DataFrame:
    pairs = hist.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar() + positives.agg(F.coalesce(F.sum("n_pos"), F.lit(0))).scalar()
    best = _best(f1_curve(hist, positives, steps), ()).select("threshold", "f1")
    none = pairs == 0
    return best.select(
        F.when(none, NO_POSITIVES_THRESHOLD).otherwise(F.col("threshold")).alias("threshold"), F.when(none, 0.0).otherwise(F.col("f1")).alias("f1")
    )


def tune_label_thresholds(scores: DataFrame, truth: DataFrame, vocab: DataFrame, steps: int = 19) -> DataFrame:
    """(label, threshold) for the whole vocabulary; a label without positives keeps the default."""
    return label_thresholds(score_histogram(with_truth(scores, truth), steps, ["label"]), n_positives(truth, ["label"]), vocab, steps)


def label_thresholds(hist: DataFrame, positives: DataFrame, vocab: DataFrame, steps: int) -> DataFrame:
    best = _best(f1_curve(hist, positives, steps, ["label"]), ["label"])
    tuned = best.where(F.col("n_pos") > 0).select("label", "threshold")
    return vocab.select("label").join(tuned, "label", "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(NO_POSITIVES_THRESHOLD))
    )


# -- losses ---------------------------------------------------------------------------------------------------


def positive_weights(frequencies: DataFrame, cap: float = 10.0) -> DataFrame:
    """(label, pos_weight) = (sum of all frequencies - f) / f, at most ``cap``."""
    total = frequencies.agg(F.sum("n")).scalar()
    weight = (total - F.col("n")) / (F.col("n") + F.lit(1e-8))
    return frequencies.select(F.col("tag").alias("label"), F.least(weight, F.lit(cap)).alias("pos_weight"))


def loss_column(
    kind: str,
    x: Column,
    y: Column,
    pos_weight: Column | None = None,
    focal_gamma: float = 2.0,
    focal_alpha: float | None = 0.25,
    asl_gamma_neg: float = 4.0,
    asl_gamma_pos: float = 1.0,
    asl_clip: float = 0.05,
) -> Column:
    """Loss of one (product, label) cell from the logit ``x`` and the 0/1 target ``y``."""
    e = F.exp(-F.abs(x))
    p = F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))
    log_loss_pos = F.greatest(-x, F.lit(0.0)) + F.log1p(e)  # -ln p
    log_loss_neg = F.greatest(x, F.lit(0.0)) + F.log1p(e)  # -ln (1 - p)
    plain = F.when(y == 1, log_loss_pos).otherwise(log_loss_neg)
    if kind == "bce":
        return plain
    if kind == "weighted_bce":
        if pos_weight is None:
            return plain
        return F.when(y == 1, pos_weight * log_loss_pos).otherwise(log_loss_neg)
    if kind == "focal":
        miss = F.when(y == 1, 1 - p).otherwise(p)
        loss = F.pow(miss, F.lit(focal_gamma)) * plain
        if focal_alpha is None:
            return loss
        return F.when(y == 1, F.lit(focal_alpha)).otherwise(F.lit(1 - focal_alpha)) * loss
    if kind == "asl":
        floor = F.lit(1e-8)
        q = 1 - p if asl_clip <= 0 else F.least(1 - p + F.lit(asl_clip), F.lit(1.0))
        pos = -F.pow(1 - p, F.lit(asl_gamma_pos)) * F.ln(F.greatest(p, floor))
        neg = -F.pow(1 - q, F.lit(asl_gamma_neg)) * F.ln(F.greatest(q, floor))
        return F.when(y == 1, pos).otherwise(neg)
    raise ValueError(f"unknown loss: {kind}")


def loss_report(
    scores: DataFrame,
    truth: DataFrame,
    kinds: Sequence[str] = ("bce", "weighted_bce", "focal", "asl"),
    by: Sequence[str] = (),
    pos_weights: DataFrame | None = None,
    **params,
) -> DataFrame:
    """Mean loss over all (product, label) cells, one column per kind; all kinds in one pass.

    ``scores`` must be complete (a row for every product and label).
    """
    rows = with_truth(scores.withColumn("prob", F.col("prob").cast("double")), truth, by)
    weight = None
    if pos_weights is not None:
        rows = rows.join(pos_weights, "label", "left")
        weight = F.coalesce("pos_weight", F.lit(1.0))
    rows = rows.withColumn("_x", logit("prob"))
    return rows.groupBy(*by).agg(
        *[F.avg(loss_column(k, F.col("_x"), F.col("y"), weight, **params)).alias(k) for k in kinds]
    )
