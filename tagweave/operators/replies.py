"""Jobs around a text-generating client: prompts, calls on executors, reply tables and their use."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tagweave.functions import text as T
from tagweave.operators.layout import durable, first_by
from tagweave.operators.products import ATTRS, review_chunks, union_lists, with_defaults
from tagweave.operators.selection import top_candidates

# A client factory runs once per task and returns prompt -> reply text.
ClientFactory = Callable[[], Callable[[str], str | None]]
FAILED_MARK = "[FAILED]"  # fixed value: tag cell of a product whose call failed


def ask(
    prompts: DataFrame,
    client: ClientFactory,
    prompt: str = "prompt",
    store: str | None = None,
    tasks: int | None = None,
    threads: int = 1,
) -> DataFrame:
    """Add ``reply`` and ``status`` (ok, empty, failed) by calling ``client`` once per distinct prompt.

    Replies are written before use, keyed by the prompt's digest, so nothing downstream repeats a call. With
    ``store`` (a folder) earlier successful replies are read back and only new prompts are sent; a failed
    call is tried again next time. ``tasks`` sets over how many tasks the prompts are dealt and ``threads`` how many calls
    a task has under way, so at most ``tasks`` x ``threads`` calls run at once.
    """
    spark = prompts.sparkSession
    keyed = prompts.withColumn("_key", F.sha2(F.col(prompt), 256))
    todo = keyed.select("_key", F.col(prompt).alias("_prompt")).where(F.col("_prompt").isNotNull()).dropDuplicates(["_key"])
    known = read_replies(spark, store) if store else None
    if known is not None:
        todo = todo.join(known.select("_key"), "_key", "left_anti")
    if tasks:
        todo = todo.repartition(tasks, "_key")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = client()

        def one(text: str) -> tuple[str | None, str]:
            try:
                reply = send(text)
                return reply, "ok" if reply and reply.strip() else "empty"
            except Exception:  # a failed call is a row with a status, not a failed job
                return None, "failed"

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                found = list(pool.map(one, batch["_prompt"]))
                yield pd.DataFrame({"_key": batch["_key"], "reply": [r for r, _ in found], "status": [s for _, s in found]})

    fresh = todo.mapInPandas(call, "_key string, reply string, status string")
    if store:
        fresh.write.mode("append").parquet(store)
        replies = _best_replies(spark.read.parquet(store))
    else:
        replies = durable(fresh)
    return keyed.join(replies, "_key", "left").drop("_key")


def _best_replies(stored: DataFrame) -> DataFrame:
    rank = F.when(F.col("status") == "ok", 0).when(F.col("status") == "empty", 1).otherwise(2)
    return stored.groupBy("_key").agg(
        F.min_by(F.struct("reply", "status"), F.struct(rank, F.col("reply"))).alias("_r")
    ).select("_key", "_r.reply", "_r.status")


def read_replies(spark: SparkSession, store: str) -> DataFrame | None:
    """Stored replies that need no new call, or None when the store does not exist yet."""
    from pyspark.errors import AnalysisException

    try:
        stored = spark.read.parquet(store)
    except AnalysisException as e:
        # Only a store that is not there yet counts as none: any other error would ask, and pay for, everything again.
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return _best_replies(stored).where(F.col("status") != "failed")


# -- tagging --------------------------------------------------------------------------------------------------


def tag_prompts(
    reviews: DataFrame,
    template: str,
    max_chars: int = T.MAX_CHARS_PER_CHUNK,
    key: str = "product_sku",
    order_by: Sequence[str] = ("comment_id",),
) -> DataFrame:
    """(product_sku, chunk_id, prompt): the non-blank reviews of a product as numbered lists in ``template``.

    ``reviews`` has one row per review, or one per product with ``comment_text`` as an array. Chunks are cut and counted over the whole product, however many reviews it has; numbers
    start at 1 in each chunk. Template fields: ``{name} {good_type} {good_subtype} {reviews} {chunk} {chunks}``.
    """
    reviews = with_defaults(reviews)
    if isinstance(reviews.schema["comment_text"].dataType, ArrayType):
        reviews = reviews.select(key, *ATTRS, F.posexplode("comment_text").alias("_pos", "comment_text"))
        order_by = ["_pos"]
    order = F.struct(*order_by)
    heads = reviews.where(F.col(key).isNotNull()).groupBy(key).agg(*[first_by(c, order, True).alias(c) for c in ATTRS])
    texts = reviews.where(T.not_blank("comment_text")).withColumn("comment_text", T.strip("comment_text"))
    rows = review_chunks(texts, max_chars, key, order_by).join(heads, key)
    prompt = T.fill_template(
        template, name="name", good_type="good_type", good_subtype="good_subtype",
        reviews=T.numbered_lines("reviews"), chunk=F.col("chunk_id") + 1, chunks="n_chunks",
    )
    return rows.select(key, "chunk_id", prompt.alias("prompt"))


def merge_tag_replies(replies: DataFrame, key: str = "product_sku", order_by: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """Reply chunks -> one tag list per product, first spelling of each tag regardless of case, in reply order."""
    return union_lists(replies, T.parse_tag_reply("reply"), key, order_by, ignore_case=True)


def tag_with_client(
    reviews: DataFrame,
    client: ClientFactory,
    template: str,
    store: str | None = None,
    tasks: int | None = None,
    threads: int = 1,
    **kwargs,
) -> DataFrame:
    """Prompts, calls and merged tags per product from one row per review.

    Products whose calls all failed are missing from the result. ``tasks`` and ``threads`` bound the calls under way, see :func:`ask`.
    """
    replies = ask(tag_prompts(reviews, template, **kwargs), client, store=store, tasks=tasks, threads=threads)
    return merge_tag_replies(replies.where(F.col("status") != "failed"))


def pending_products(products: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Products without usable tags but with at least one non-blank review (``comment_text`` array).

    A failed mark counts as untagged whether or not it has been cleared by ``retry_failed`` before.
    """
    tags = F.when(F.col("tags") == FAILED_MARK, "").otherwise(F.col("tags")) if retry_failed else F.col("tags")
    untagged = ~T.not_blank(tags) | (T.strip(tags) == FAILED_MARK)
    return products.where(F.coalesce(untagged, F.lit(True)) & F.exists("comment_text", T.not_blank))


def write_back_tags(products: DataFrame, new_tags: DataFrame, key: str = "product_sku") -> DataFrame:
    """Take the new tags where there are some, keep the old ones elsewhere."""
    fresh = new_tags.select(key, F.col("tags").alias("_new"))
    return products.join(fresh, key, "left").withColumn("tags", F.coalesce("_new", "tags")).drop("_new")


def resume(todo: DataFrame, done: DataFrame, key: str = "product_sku") -> DataFrame:
    """Rows whose key is not in the stored output yet."""
    return todo.join(done.select(key), key, "left_anti")


# -- reranking ------------------------------------------------------------------------------------------------


def candidate_lists(scores: DataFrame, n: int = 20, positive_only: bool = True) -> DataFrame:
    """(product_sku, good_type, candidates array<struct<tag,score>>): at most ``n`` labels, best first."""
    items = F.array_sort(F.collect_list(F.struct("rank", F.col("label").alias("tag"), F.col("prob").alias("score"))))
    return top_candidates(scores, n, positive_only).groupBy("product_sku", "good_type").agg(
        F.transform(items, lambda x: F.struct(x["tag"].alias("tag"), x["score"].alias("score"))).alias("candidates")
    )


def rerank_prompts(
    candidates: DataFrame, texts: DataFrame, template: str, max_return: int = 5, max_input_chars: int = 2000
) -> DataFrame:
    """Add ``prompt``; template fields ``{good_type} {text} {candidates} {max_return}``."""
    # One text per product: of several rows the smallest text stands for it, so nothing is asked or returned twice.
    one = texts.groupBy("product_sku").agg(F.min("text").alias("text"))
    rows = candidates.join(one, "product_sku", "left")
    category = F.coalesce(F.nullif(F.col("good_type").cast("string"), F.lit("")), F.lit("unknown"))
    prompt = T.fill_template(
        template, good_type=category, text=T.trim_text("text", max_input_chars),
        candidates=T.candidate_lines("candidates"), max_return=F.lit(max_return),
    )
    return rows.withColumn("prompt", prompt).drop("text")


def apply_rerank_replies(
    replies: DataFrame, max_return: int = 5, sort: bool = False, dedupe: bool = False
) -> DataFrame:
    """(product_sku, good_type, label, prob, rank) from ``candidates`` and ``reply``; nothing for unusable replies.

    Reply order and repeated tags stay unless ``sort`` or ``dedupe`` is set.
    """
    parsed = T.parse_rerank_reply("reply", "candidates", max_return)
    replies = replies.select("product_sku", "good_type", parsed.alias("_p"))
    found = F.col("_p")
    if dedupe:
        # The fold sees the parsed reply once, whatever its length.
        found = F.aggregate(
            found, F.filter(found, lambda x: F.lit(False)),
            lambda acc, x: F.when(F.exists(acc, lambda y: y["tag"] == x["tag"]), acc).otherwise(F.concat(acc, F.array(x))),
        )
    if sort:
        found = F.array_sort(
            found, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)
        )
    return (
        replies.select("product_sku", "good_type", F.posexplode_outer(found).alias("_i", "_x"))
        .where(F.col("_x").isNotNull())
        .select(
            "product_sku", "good_type", F.col("_x.tag").alias("label"), F.col("_x.score").alias("prob"),
            (F.col("_i") + 1).alias("rank"),
        )
    )


def rerank(
    scores: DataFrame,
    texts: DataFrame,
    client: ClientFactory,
    template: str,
    max_candidates: int = 20,
    max_return: int = 5,
    max_input_chars: int = 2000,
    positive_only: bool = True,
    store: str | None = None,
    tasks: int | None = None,
    threads: int = 1,
) -> DataFrame:
    """Reranked tags per product; products with an empty, failed or unusable reply have no rows."""
    prompts = rerank_prompts(
        candidate_lists(scores, max_candidates, positive_only), texts, template, max_return, max_input_chars
    )
    return apply_rerank_replies(ask(prompts, client, store=store, tasks=tasks, threads=threads), max_return)


def prefer_reranked(reranked: DataFrame, selected: DataFrame) -> DataFrame:
    """Reranked tags where a product has any, the threshold choice elsewhere."""
    rest = selected.join(reranked.select("product_sku").distinct(), "product_sku", "left_anti")
    return reranked.unionByName(rest)
