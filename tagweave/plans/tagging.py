"""Whole jobs: dataset preparation, prediction, evaluation, pool consolidation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions import text as T
from tagweave.operators import labels as L
from tagweave.operators import metrics as M
from tagweave.operators import pools as P
from tagweave.operators import priors as R
from tagweave.operators import scoring as S
from tagweave.operators import selection as C
from tagweave.operators.layout import durable, first_by
from tagweave.operators.long_texts import piece_windows, prompt_text
from tagweave.operators.products import aggregate_products, product_text_chunks
from tagweave.operators.replies import ClientFactory, ask, prefer_reranked, rerank
from tagweave.operators.sampling import stratified_split
from tagweave.operators.similarity import LOCAL_GROUP_ROWS, cluster_tags
from tagweave.sources.artifacts import Artifacts
from tagweave.sources.tables import read_tag_pool


@dataclass
class Dataset:
    """``products`` has product_sku, good_type, text and split; ``truth`` is (product_sku, good_type, split, label)."""

    products: DataFrame
    truth: DataFrame
    vocab: DataFrame
    allowed: DataFrame | None
    windows: DataFrame


def prepare_dataset(
    reviews: DataFrame,
    pool: DataFrame | None = None,
    order_by: Sequence[str] = ("comment_id",),
    test: float = 0.1,
    val: float = 0.1,
    min_label_freq: int = 3,
    window: int = 256,
    overlap: int = 128,
    seed: int = 42,
) -> Dataset:
    """Reviews with tags -> products, split, vocabulary of the train split, allow-list and token windows.

    The numbers' defaults are fixed values of the method.
    """
    products = durable(aggregate_products(reviews, order_by))
    split = stratified_split(products.select("product_sku", "good_type"), "product_sku", "good_type", test, val, seed)
    # One row per product meets the split; its tags come apart behind that.
    long = products.select("product_sku", "tags").join(split, "product_sku").select(*split.columns, F.explode("tags").alias("tag"))
    rows, vocab = L.apply_label_vocab(long, min_label_freq)
    truth = durable(rows.select("product_sku", "good_type", "split", F.col("tag").alias("label")))
    kept = truth.select("product_sku", "split").distinct()
    out = products.select("product_sku", "good_type", "text").join(kept, "product_sku")
    windows = S.token_windows(out.withColumn("tokens", S.blank_tokens("text")), "tokens", size=window, overlap=overlap)
    allowed = None if pool is None else read_tag_pool(pool).withColumnRenamed("tag", "label")
    return Dataset(out, truth, vocab.select("label_id", "label"), allowed, windows)


def priors_from_reviews(
    reviews: DataFrame, vocab: DataFrame, alpha: float = 1.0, order_by: Sequence[str] = ("comment_id",)
) -> DataFrame:
    """Category priors straight from tagged reviews, without a model: lowercased tags and labels, stripped categories.

    Products without tags do not count; tags outside the vocabulary do not matter.
    """
    rows = reviews.withColumn("comment_text", F.lit(None).cast("string"))
    tagged = durable(aggregate_products(rows, order_by, lower=True).where(F.size("tags") > 0))
    products = tagged.select("product_sku", T.strip(F.coalesce("good_type", F.lit(""))).alias("good_type"), "tags")
    labels = vocab.select(F.lower("label").alias("label")).distinct()
    truth = products.select("product_sku", "good_type", F.explode("tags").alias("label")).join(labels, "label", "left_semi")
    return R.category_priors(R.category_label_stats(truth, products), labels, alpha)


def calibrated_scores(
    chunk_scores: DataFrame, artifacts: Artifacts, fallback: bool = False, strip_key: bool = True
) -> DataFrame:
    """Max over chunks, prior blend, allow-list mask."""
    scores = C.max_pool_scores(chunk_scores)
    if artifacts.priors is not None and artifacts.category_prior_weight > 0:
        scores = C.blend_prior(scores, artifacts.priors, artifacts.category_prior_weight, fallback, strip_key)
    if artifacts.allowed is not None:
        scores = C.apply_allow_list(scores, artifacts.allowed)
    return scores


def predict_from_scores(
    chunk_scores: DataFrame,
    artifacts: Artifacts,
    per_label: bool = True,
    reranker: ClientFactory | None = None,
    texts: DataFrame | None = None,
    template: str = "{good_type}\n{text}\n{candidates}\n{max_return}",
    rerank_top_n: int = 20,
    rerank_max: int | None = None,
    min_tags: int = 1,
    fallback: bool = False,
    tasks: int | None = None,
    threads: int = 1,
    max_input_chars: int = 2000,
) -> DataFrame:
    """Chosen tags (product_sku, good_type, label, prob, rank) from chunk scores."""
    scores = calibrated_scores(chunk_scores, artifacts, fallback)
    # The global threshold is one number, read from the one-row part of the artifact table.
    overall = artifacts.thresholds.where(F.col("label").isNull()).select("threshold").first()
    default = overall[0] if overall is not None else C.DEFAULT_THRESHOLD
    thresholds = artifacts.thresholds if per_label else default
    selected = C.select_tags(scores, thresholds, artifacts.top_k, min_tags, default=default)
    if reranker is None:
        return selected
    scores = durable(scores)
    selected = C.select_tags(scores, thresholds, artifacts.top_k, min_tags, default=default)
    better = rerank(
        scores, texts, reranker, template, max_candidates=rerank_top_n, max_return=rerank_max or artifacts.top_k,
        max_input_chars=max_input_chars, tasks=tasks, threads=threads,
    )
    return prefer_reranked(better, selected)


def predict_tags(df: DataFrame, scorer: S.Scorer, artifacts: Artifacts, **kwargs) -> DataFrame:
    """Score product texts or windows with ``scorer`` and choose tags."""
    return predict_from_scores(S.score(df, scorer), artifacts, texts=df, **kwargs)


def predict_long(
    reviews: DataFrame,
    scorer: S.Scorer,
    artifacts: Artifacts,
    order_by: Sequence[str] = ("comment_id",),
    size: int = 256,
    overlap: int = 128,
    reranker: ClientFactory | None = None,
    max_input_chars: int = 2000,
    **kwargs,
) -> DataFrame:
    """Choose tags straight from reviews, for products of any size: the scorer reads token windows of the product text, the best score of a
    product's windows counts, and a reranker reads the first ``max_input_chars`` characters. No row ever holds a product's whole text.
    """
    pieces = durable(product_text_chunks(reviews, max(T.MAX_CHARS_PER_CHUNK, max_input_chars + 100), order_by))
    order = F.struct(*order_by)
    heads = reviews.where(F.col("product_sku").isNotNull()).groupBy("product_sku").agg(first_by("good_type", order, False).alias("good_type"))
    windows = piece_windows(pieces, size, overlap, carry=heads)
    texts = None
    if reranker is not None:
        texts = prompt_text(pieces, max_input_chars)
    return predict_from_scores(S.score(windows, scorer), artifacts, reranker=reranker, texts=texts, max_input_chars=max_input_chars, **kwargs)


def evaluate(scores: DataFrame, truth: DataFrame, products: DataFrame, vocab: DataFrame, tune_on: str = "val", steps: tuple[int, int] = (37, 19)) -> DataFrame:
    """Tune on one split, report both kinds of thresholds on every split: (split, mode, metrics).

    ``scores`` and ``truth`` are pairs with ``prob`` and without; ``products`` has (product_sku, split). The scores are read once: a histogram by
    split, label and both threshold grids holds all that tuning and reports need, as every threshold lies on a grid or is the default.
    """
    vocab = durable(vocab.select("label"))
    per_product = products.select("product_sku", "split").join(M.label_sets(truth), "product_sku", "left")
    rows = scores.select("product_sku", "label", F.col("prob").cast("double").alias("prob")).join(per_product, "product_sku")
    y = F.coalesce(F.array_contains("true_labels", F.col("label")), F.lit(False)).cast("int")
    coarse, fine = M.grid(steps[0]), M.grid(steps[1])
    cells = rows.select(
        "split", "label", y.alias("y"), M.bucket("prob", coarse).alias("_g"), M.bucket("prob", fine).alias("_l"),
        (F.col("prob") >= M.NO_POSITIVES_THRESHOLD).alias("_d"),
    ).groupBy("split", "label", "_g", "_l", "_d").agg(F.count(F.lit(1)).alias("_n"), F.sum("y").alias("_y"))
    cells = durable(cells)
    positives = per_product.select("split", F.explode("true_labels").alias("label")).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_pos"))
    positives = durable(positives)
    here, known = cells.where(F.col("split") == tune_on), positives.where(F.col("split") == tune_on)

    def hist(bucket: str, *by: str) -> DataFrame:
        return here.groupBy(*by, F.col(bucket).alias("_b")).agg(F.sum("_n").alias("_n"), F.sum("_y").alias("_y"))

    overall = M.global_threshold(hist("_g"), known.agg(F.sum("n_pos").alias("n_pos")), steps[0]).select("threshold")
    per_label = M.label_thresholds(hist("_l", "label"), known.select("label", "n_pos"), vocab, steps[1])
    at = F.array_position(F.array(*[F.lit(x) for x in fine]), F.col("threshold"))
    limits = per_label.select("label", F.nullif(at, F.lit(0)).alias("_at"))
    place = F.array_position(F.array(*[F.lit(x) for x in coarse]), overall.scalar())
    by_default = F.col("_d")
    modes = cells.join(limits, "label", "left").select(
        "split", "label", "_n", "_y",
        F.explode(F.array(
            F.struct(F.lit("global").alias("mode"), F.when(place > 0, F.col("_g") >= place).otherwise(by_default).alias("p")),
            F.struct(F.lit("per_label").alias("mode"), F.when(F.col("_at").isNotNull(), F.col("_l") >= F.col("_at")).otherwise(by_default).alias("p")),
        )).alias("m"),
    ).select("split", "label", "_n", "_y", "m.*")
    counts = modes.groupBy("split", "mode", "label").agg(
        F.sum(F.when(F.col("p"), F.col("_y")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("p"), F.col("_n") - F.col("_y")).otherwise(0)).alias("fp"),
    )
    wanted = positives.select("split", "label", F.col("n_pos").alias("_t"), F.explode(F.array(F.lit("global"), F.lit("per_label"))).alias("mode"))
    counts = counts.join(wanted, ["split", "mode", "label"], "full").select(
        "split", "mode", "label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp")],
        (F.coalesce("_t", F.lit(0)) - F.coalesce("tp", F.lit(0))).alias("fn"),
    )
    sums = M.summed_counts(counts, vocab, ["split", "mode"])
    totals = counts.join(vocab.select("label"), "label", "left_semi").groupBy("split", "mode").agg(F.sum(F.col("tp") + F.col("fp")).alias("_p"))
    n = products.groupBy("split").agg(F.count(F.lit(1)).alias("_products"))
    out = sums.join(totals, ["split", "mode"]).join(n, "split")
    return out.withColumn("avg_pred_tags", F.coalesce(F.try_divide(F.col("_p").cast("double"), F.col("_products").cast("double")), F.lit(0.0))).drop("_p", "_products")


def evaluate_calibrated(
    chunk_scores: DataFrame, artifacts: Artifacts, truth: DataFrame, products: DataFrame, vocab: DataFrame, fallback: bool = True
) -> DataFrame:
    """:func:`evaluate` on what prediction uses: pooled scores with category priors (global ones for unknown categories) and allow-list."""
    return evaluate(calibrated_scores(chunk_scores, artifacts, fallback), truth, products, vocab)


def baseline_report(products: DataFrame, truth: DataFrame, stats: DataFrame, vocab: DataFrame, ks: Sequence[int] = (2, 3)) -> DataFrame:
    """(k, micro_f1, avg_pred_tags) of the category-frequency baseline for each k; an undefined ratio is 0.

    All products of a category get the same labels, so predictions and hits are counts per category and label, and labels are ranked once
    up to the largest k. No (product, label) prediction is ever made.
    """
    top = durable(R.category_topk(stats, vocab, max(ks)))
    known = top.where(F.col("good_type").isNotNull()).select(F.col("good_type").alias("_t")).distinct()
    sizes = durable(products.groupBy("good_type").agg(F.count(F.lit(1)).alias("_n")))
    routed = sizes.withColumnRenamed("good_type", "_own").join(known, F.col("_own") == F.col("_t"), "left")
    guesses = routed.join(top, F.col("_t").eqNullSafe(F.col("good_type"))).select("_own", "_n", "label", "rank")
    here = truth.select("product_sku", "label").join(products.select("product_sku", "good_type"), "product_sku")
    found = here.groupBy(F.col("good_type").alias("_c"), F.col("label").alias("_l")).agg(F.count(F.lit(1)).alias("_y"))
    hits = guesses.join(found, F.col("_own").eqNullSafe(F.col("_c")) & (F.col("label") == F.col("_l")), "left")
    cuts = F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: F.col("rank") <= k)).alias("k")
    sums = hits.select(cuts, "_n", F.coalesce("_y", F.lit(0)).alias("_y")).groupBy("k").agg(F.sum("_n").alias("_p"), F.sum("_y").alias("_h"))
    n_true = truth.join(vocab.select("label"), "label", "left_semi").agg(F.count(F.lit(1))).scalar()
    n_products = sizes.agg(F.sum("_n")).scalar()
    every = products.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    predicted, hit = F.coalesce("_p", F.lit(0)), F.coalesce("_h", F.lit(0))
    return every.join(sums, "k", "left").select(
        "k", ratio(2 * hit, predicted + n_true).alias("micro_f1"), ratio(predicted, n_products).alias("avg_pred_tags")
    )


def consolidate_pool(
    pool: DataFrame,
    vectors: DataFrame,
    chooser: P.Chooser = P.frequent_tag_chooser,
    threshold: float = 0.91,
    replies: DataFrame | None = None,
    filter_client: ClientFactory | None = None,
    template: str = "{good_type}\n{tags}",
    tasks: int | None = None,
    threads: int = 1,
    local_rows: int = LOCAL_GROUP_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Pool (good_type, tag[, freq]) and vectors (good_type, tag, vector) -> (best tags, mapping rules).

    Similar tags are clustered per category, every cluster is reduced to its best tag, and an optional filter
    reply per category keeps or merges the rest. Rules of the clusters come first, reply rules after them.
    """
    clusters = cluster_tags(vectors, threshold, id_col="tag", local_rows=local_rows)
    members = clusters.join(pool, ["good_type", "tag"])
    consolidated = durable(P.consolidate_clusters(members, chooser))
    tags, rules = P.consolidated_tags(consolidated), P.build_mapping(consolidated)
    if filter_client is not None:
        replies = ask(filter_prompts(tags, template), filter_client, tasks=tasks, threads=threads)
    if replies is None:
        return tags, rules
    kept, reply_rules = P.filter_pool(replies)
    return kept, P.join_rules(rules, reply_rules)


def filter_prompts(tags: DataFrame, template: str, per_prompt: int | None = None) -> DataFrame:
    """(good_type, slot, prompt): the tags of a category as a JSON list, one prompt per category.

    ``per_prompt`` splits larger categories over several prompts of about that many tags, for clients with short inputs; tags of
    different prompts can then not be merged.
    """
    slot = F.lit(0)
    if per_prompt:
        sizes = tags.groupBy("good_type").agg(F.ceil(F.count(F.lit(1)) / F.lit(per_prompt)).alias("_n"))
        tags, slot = tags.join(sizes, "good_type"), F.pmod(F.xxhash64("tag"), F.col("_n")).cast("int")
    lists = tags.groupBy("good_type", slot.alias("slot")).agg(F.array_sort(F.collect_set("tag")).alias("_tags"))
    return lists.select("good_type", "slot", T.fill_template(template, good_type="good_type", tags=F.to_json("_tags")).alias("prompt"))


def client_chooser(client: ClientFactory, template: str = "{good_type}\n{tags}", tasks: int | None = None, threads: int = 1) -> P.Chooser:
    """Cluster chooser that asks a client for the best tag of every cluster."""
    def choose(clusters: DataFrame) -> DataFrame:
        lists = clusters.groupBy("good_type", "cluster_id").agg(F.array_sort(F.collect_set("tag")).alias("_tags"))
        prompts = lists.select(
            "good_type", "cluster_id",
            T.fill_template(template, good_type="good_type", tags=F.to_json("_tags")).alias("prompt"),
        )
        return ask(prompts, client, tasks=tasks, threads=threads).select("good_type", "cluster_id", T.parse_choice_reply("reply").alias("best_tag"))

    return choose
