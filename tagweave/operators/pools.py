"""Tag pools per category, mapping rules, tag rewriting, consolidation and tag statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.functions import text as T
from tagweave.operators.layout import durable
from tagweave.operators.products import explode_tags, product_tags, tag_lists


def build_tag_pools(df: DataFrame, by: str = "good_type", column: str = "tags", lower: bool = True) -> DataFrame:
    """Long pool (category, tag): the distinct tags of every category."""
    return explode_tags(df.where(F.col(by).isNotNull()), [by], column, lower).distinct()


def pool_rows(pool: DataFrame, by: str = "good_type", per_row: int | None = None) -> DataFrame:
    """Long pool -> rows ``by, tags`` with sorted tags, one row per category, the form used in CSV files.

    The long pool is the form for further work. ``per_row`` spreads a category over several rows of about that many tags (whole tags,
    by hash; numbered by ``part``); the pool reader unions them again.
    """
    lists = T.join_tags(F.array_sort(F.collect_set("tag"))).alias("tags")
    if not per_row:
        return pool.groupBy(by).agg(lists)
    sizes = pool.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / F.lit(per_row)).alias("_parts"))
    part = F.pmod(F.xxhash64("tag"), F.col("_parts")).cast("int")
    return pool.join(sizes, by).groupBy(by, part.alias("part")).agg(lists)


def pool_sizes(pool: DataFrame, by: str = "good_type") -> DataFrame:
    """Distinct tags per category; the pool is already distinct, so a plain count is enough."""
    return pool.groupBy(by).agg(F.count(F.lit(1)).alias("n_tags"))


def latest_rules(mapping: DataFrame, by: str = "good_type") -> DataFrame:
    """One rule per (category, old tag): the last one in ``ord`` wins."""
    return mapping.groupBy(by, "old_tag").agg(F.max_by("new_tag", "ord").alias("new_tag"))


def resolve_chains(rules: DataFrame, by: str = "good_type") -> DataFrame:
    """Follow rules whose target has a rule of its own to the end of the chain, however long.

    Every round doubles the links that are covered and is a written table; rounds end when no target moves on. A cycle has no
    end: all its members, and what leads into it, get the cycle's smallest tag, and that tag itself has no rule.
    """
    links = durable(rules.select(F.col(by).alias("_t"), "old_tag", "new_tag").where("old_tag <> new_tag"))
    # The smallest tag passed on the way shows cycles: after enough rounds a target inside a cycle has seen all of it.
    now = links.withColumn("_low", F.col("new_tag"))
    longest = links.count()
    covered = 1
    while covered <= 2 * longest:
        nxt = now.select(F.col("_t").alias("_nt"), F.col("old_tag").alias("_old"), F.col("new_tag").alias("_next"), F.col("_low").alias("_next_low"))
        step = now.join(nxt, (F.col("_t") == F.col("_nt")) & (F.col("new_tag") == F.col("_old")), "left").select(
            "_t", "old_tag", F.coalesce("_next", "new_tag").alias("new_tag"), F.least("_low", F.coalesce("_next_low", "_low")).alias("_low"),
            F.col("_next").isNotNull().alias("_moved"),
        )
        now = durable(step)
        if not now.where("_moved").limit(1).count():
            break
        now, covered = now.drop("_moved"), covered * 2
    # Whoever still stands on a tag with a rule is in a cycle or leads into one.
    heads = links.select(F.col("_t").alias("_ct"), F.col("old_tag").alias("_c")).distinct()
    caught = now.drop("_moved").join(heads, (F.col("_t") == F.col("_ct")) & (F.col("new_tag") == F.col("_c")), "left")
    around = now.select(F.col("_t").alias("_at"), F.col("old_tag").alias("_a"), F.col("_low").alias("_cycle"))
    out = caught.join(around, F.col("_c").isNotNull() & (F.col("_t") == F.col("_at")) & (F.col("new_tag") == F.col("_a")), "left")
    out = out.select(F.col("_t").alias(by), "old_tag", F.coalesce("_cycle", "new_tag").alias("new_tag"))
    return out.where("old_tag <> new_tag")


def apply_tag_mapping(long: DataFrame, mapping: DataFrame, by: str = "good_type", transitive: bool = False) -> DataFrame:
    """Replace ``tag`` through the rules of its category; a rule to an empty tag makes it null.

    Rows are kept. Spark broadcasts the rules when their measured size allows it and splits skewed tags otherwise.
    """
    rules = latest_rules(mapping, by)
    if transitive:
        rules = resolve_chains(rules, by)
    rules = rules.select(F.col(by).alias("_t"), F.col("old_tag").alias("_old"), F.coalesce("new_tag", F.lit("")).alias("_new"))
    joined = long.join(rules, (F.col(by) == F.col("_t")) & (F.col("tag") == F.col("_old")), "left")
    return joined.withColumn("tag", F.nullif(F.coalesce("_new", "tag"), F.lit(""))).drop("_t", "_old", "_new")


def filter_to_pool(long: DataFrame, pool: DataFrame, by: str = "good_type", keep_rows: bool = False) -> DataFrame:
    """Keep the tags that are in the pool of their category; with ``keep_rows`` the others become null."""
    known = pool.select(F.col(by).alias("_t"), F.col("tag").alias("_tag")).distinct()
    cond = (F.col(by) == F.col("_t")) & (F.col("tag") == F.col("_tag"))
    if not keep_rows:
        return long.join(known, cond, "left_semi")
    return long.join(known, cond, "left").withColumn("tag", F.col("_tag")).drop("_t", "_tag")


def rewrite_tags(
    tagged: DataFrame,
    mapping: DataFrame,
    pool: DataFrame,
    transitive: bool = False,
    key: str = "product_sku",
    by: str = "good_type",
    order_by: Sequence[str] = ("comment_id",),
) -> DataFrame:
    """Rewrite tag cells: lowercase, map, keep pool tags, drop repeats (first position wins).

    Every ``key`` stays, possibly with an empty list. A category without a pool loses all its tags.
    """
    lists = product_tags(tagged, key, order_by, lower=True, carry=[by])
    cells = lists.select(key, by, F.posexplode_outer("tags").alias("pos", "tag"))
    mapped = filter_to_pool(apply_tag_mapping(cells, mapping, by, transitive), pool, by, keep_rows=True)
    return tag_lists(mapped, key).withColumn("tags", F.array_distinct("tags"))


def rewrite_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows with tags and tag counts before and after (array column ``tags``), and the reduction in percent."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.coalesce(F.sum(F.when(F.size("tags") > 0, 1).otherwise(0)), F.lit(0)).alias(f"rows_{name}"),
            F.coalesce(F.sum(F.size("tags")), F.lit(0)).alias(f"tags_{name}"),
        )

    later = counts(after, "after")
    both = counts(before, "before").withColumns(
        {c: later.select(c).scalar() for c in ("rows_after", "tags_after")}
    )
    kept = F.try_divide(F.col("tags_after").cast("double"), F.col("tags_before").cast("double"))
    return both.withColumn("reduction_pct", 100 * (1 - kept))


def canonicalise_dataset(rows: DataFrame, matches: DataFrame, key: str = "product_sku") -> DataFrame:
    """Raw (key, tag) rows and matches (raw_id, canonical_id) -> sorted distinct canonical tags per key.

    Keys without any match drop out. Matching runs on distinct raw tags beforehand, once per tag.
    """
    mapped = rows.join(matches.select(F.col("raw_id").alias("tag"), "canonical_id"), "tag").select(key, "canonical_id")
    return mapped.distinct().groupBy(key).agg(F.array_sort(F.collect_set("canonical_id")).alias("tags"))


def tag_profile(
    products: DataFrame, product_tags: DataFrame, key: str = "product_sku", top_n: int = 50
) -> DataFrame:
    """Corpus figures in one row: tags per product, untagged share, distinct tags, median frequency, top coverage.

    ``products`` lists every product once; ``product_tags`` holds distinct (key, tag) pairs. Percentiles run on frequency
    tables, which stay small whatever the number of products.
    """
    pairs = product_tags.select(key, "tag")
    per_product = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sizes = products.select(key).join(per_product, key, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    size_hist = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    of_products = size_hist.agg(
        F.sum("c").alias("n_products"),
        (F.sum(F.col("n") * F.col("c")) / F.sum("c")).alias("mean_tags"),
        F.expr("percentile(n, 0.5D, c)").alias("median_tags"),
        F.expr("percentile(n, 0.9D, c)").alias("p90_tags"),
        (F.sum(F.when(F.col("n") == 0, F.col("c")).otherwise(0)) / F.sum("c")).alias("untagged_share"),
    )
    freq = pairs.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    # Frequencies of tags as a histogram: few rows, and enough for median and top coverage alike.
    freq_hist = freq.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    higher = F.coalesce(F.sum("c").over(W.orderBy(F.col("n").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    in_top = F.greatest(F.least(F.col("c"), F.lit(top_n) - higher), F.lit(0))
    of_tags = freq_hist.select("n", "c", in_top.alias("t")).agg(
        F.struct(
            F.sum("c").alias("n_tags"),
            F.expr("percentile(n, 0.5D, c)").alias("median_frequency"),
            F.try_divide(F.sum(F.col("n") * F.col("t")), F.sum(F.col("n") * F.col("c"))).alias("top_coverage"),
        )
    )
    return of_products.withColumn("_tags", of_tags.scalar()).select("*", "_tags.*").drop("_tags")


# -- consolidation --------------------------------------------------------------------------------------------

Chooser = Callable[[DataFrame], DataFrame]


def frequent_tag_chooser(clusters: DataFrame) -> DataFrame:
    """Best tag of a cluster: the most frequent, then the shortest, then the smallest."""
    freq = F.col("freq") if "freq" in clusters.columns else F.lit(0)
    rank = F.struct((-freq).alias("f"), F.length("tag").alias("l"), F.col("tag").alias("t"))
    return clusters.groupBy("good_type", "cluster_id").agg(F.min_by("tag", rank).alias("best_tag"))


def consolidate_clusters(clusters: DataFrame, chooser: Chooser = frequent_tag_chooser) -> DataFrame:
    """Best tag for every cluster of two or more tags, plus the tags that stand alone.

    Input (good_type, cluster_id, tag[, freq]); output adds ``best_tag`` and ``n_members`` to every member row.
    ``chooser`` gets the member rows of multi-member clusters and returns (good_type, cluster_id, best_tag);
    an empty or missing best tag drops the whole cluster.
    """
    sizes = clusters.groupBy("good_type", "cluster_id").agg(F.count(F.lit(1)).alias("n_members"))
    members = clusters.join(sizes, ["good_type", "cluster_id"])
    multi = members.where(F.col("n_members") > 1)
    best = chooser(multi.drop("n_members"))
    chosen = multi.join(best, ["good_type", "cluster_id"], "left").withColumn(
        "best_tag", F.coalesce(F.lower(T.strip("best_tag")), F.lit(""))
    )
    single = members.where(F.col("n_members") == 1).withColumn("best_tag", F.col("tag"))
    return chosen.unionByName(single)


def build_mapping(consolidated: DataFrame) -> DataFrame:
    """Rules member -> best tag of the multi-member clusters; a best tag that is a member gets no rule."""
    rules = consolidated.where(
        (F.col("n_members") > 1) & (F.col("best_tag") != "") & (F.col("tag") != F.col("best_tag"))
    )
    return rules.select("good_type", F.col("tag").alias("old_tag"), F.col("best_tag").alias("new_tag"), F.lit(0).alias("ord"))


def consolidated_tags(consolidated: DataFrame) -> DataFrame:
    return (
        consolidated.where(F.col("best_tag") != "").select("good_type", F.col("best_tag").alias("tag")).distinct()
    )


def filter_pool(replies: DataFrame, reply: str = "reply") -> tuple[DataFrame, DataFrame]:
    """Pool-filter replies (good_type, reply) -> (kept tags, rules)."""
    # Stored: both results read it, and a reply is long to parse.
    parsed = durable(replies.select("good_type", T.parse_pool_reply(reply).alias("r")))
    # The outer form: for a plain explode Spark infers a size filter below it that would parse every reply again.
    kept = parsed.select("good_type", F.explode_outer("r.kept").alias("tag")).where(F.col("tag").isNotNull()).distinct()
    rules = parsed.select("good_type", F.explode_outer("r.rules").alias("rule")).select("good_type", "rule.*")
    return kept, rules.where(F.col("old_tag").isNotNull())


def join_rules(cluster_rules: DataFrame, reply_rules: DataFrame) -> DataFrame:
    """Cluster rules first, reply rules after them, so that a reply rule wins for the same old tag."""
    return cluster_rules.unionByName(reply_rules.withColumn("ord", F.col("ord") + 1))
