"""Named queries over the fixture views, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions import text as T
from tagweave.functions.numeric import cosine
from tagweave.operators import approximate as N
from tagweave.operators import labels as L
from tagweave.operators import long_texts as X
from tagweave.operators import metrics as M
from tagweave.operators import pools as P
from tagweave.operators import priors as R
from tagweave.operators import products as A
from tagweave.operators import replies as Q
from tagweave.operators import resumable as RS
from tagweave.operators import sampling as O
from tagweave.operators import scoring as S
from tagweave.operators import selection as C
from tagweave.operators import similarity as V
from tagweave.operators.layout import durable, first_by, shared_folder
from tagweave.plans import tagging
from tagweave.plans.fixtures import SEED, UNLISTED_TYPE, Views, with_views
from tagweave.sources import artifacts as AR
from tagweave.sources import tables as TB

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None, extra: dict | None = None):
    def register(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(list(views), sql, extra)
        return fn

    return register


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


ORDER = ("ord1", "ord2")

# -- products -------------------------------------------------------------------------------------------------

_TEXT_SQL = """select product_sku, min(name) as name, min(good_type) as good_type, min(good_subtype) as good_subtype,
    concat_ws(' | ', trim(min(name)), trim(min(good_type)), trim(min(good_subtype)),
              string_agg(comment_text, ' ' order by comment_id)) as text,
    string_agg(comment_text, chr(10) order by comment_id) as comments, count(*) as n_comments
    from reviews group by product_sku"""
PRODUCT_SQL = {"product_texts": (["reviews"], _TEXT_SQL)}


@query("product_text", ("product_texts",),
       "select product_sku, name, good_type, good_subtype, text from product_texts", PRODUCT_SQL)
def product_text(v: Views) -> DataFrame:
    return A.aggregate_products(v.reviews()).select("product_sku", *A.ATTRS, "text")


@query("product_tags", ("tag_cells",), """select product_sku, string_agg(tag, '; ' order by pos) as tags from (
    select product_sku, tag, min(pos) as pos from (
        select *, row_number() over (partition by product_sku order by ord1, ord2, i) as pos from tag_cells)
    group by all) group by product_sku""")
def product_tags(v: Views) -> DataFrame:
    return A.product_tags(v.tagged(), order_by=ORDER).select("product_sku", T.join_tags("tags").alias("tags"))


@query("product_explorer", ("product_texts",), """select product_sku, concat(product_sku, ' — ', name) as option_label,
    cast(n_comments as int) as n_comments, comments, length(text) as n_chars from product_texts""", PRODUCT_SQL)
def product_explorer(v: Views) -> DataFrame:
    return A.product_explorer(v.reviews()).select(
        "product_sku", "option_label", F.size("comments").alias("n_comments"),
        F.array_join("comments", "\n").alias("comments"), F.length("text").cast("long").alias("n_chars"),
    )


@query("grouped_reviews_min4", ("reviews",), """select product_sku, count(*) as n_reviews, min(name) as name,
    min(good_type) as good_type, '[' || string_agg(cast(comment_id as varchar), ',' order by comment_id) || ']' as comment_ids,
    string_agg(comment_text, chr(10) order by comment_id) as comments
    from reviews group by product_sku having count(*) >= 4""")
def grouped_reviews_min4(v: Views) -> DataFrame:
    return A.min_reviews(A.group_reviews(v.reviews()), 4).select(
        "product_sku", "n_reviews", "name", "good_type", F.to_json("comment_id").alias("comment_ids"),
        F.array_join("comment_text", "\n").alias("comments"),
    )


@query("rows_of_busy_products", ("conv_reviews",), """select product_sku,
    string_agg(comment_text, chr(10) order by comment_id) as comment_text, arg_min(name, comment_id) as name,
    arg_min(good_type, comment_id) as good_type, count(distinct comment_id) as n_comments
    from conv_reviews where product_sku in (select product_sku from conv_reviews group by 1 having count(comment_id) >= 5)
    and comment_text is not null group by product_sku""")
def rows_of_busy_products(v: Views) -> DataFrame:
    return A.concat_reviews(A.rows_of_busy_products(v.conv_reviews(), 5)).select(
        "product_sku", "comment_text", "name", "good_type", "n_comments"
    )


@query("first_attrs", ("conv_reviews",), """select product_sku, min(comment_id) as comment_id,
    arg_min(comment_text, comment_id) as comment_text, arg_min(name, comment_id) as name,
    arg_min(good_type, comment_id) as good_type, arg_min(good_subtype, comment_id) as good_subtype
    from conv_reviews group by product_sku""")
def first_attrs(v: Views) -> DataFrame:
    return A.first_rows(v.conv_reviews())


@query("type_rollup", ("reviews",), """select good_type, count(*) as n_rows, count(distinct product_sku) as n_products
    from reviews group by rollup (good_type)""")
def type_rollup(v: Views) -> DataFrame:
    return A.type_rollup(v.reviews())


@query("merged_sources", ("reviews", "conv_reviews"), """select product_sku, comment_text, name, speaker from (
    select comment_id, product_sku, comment_text, name, cast(null as varchar) as speaker, good_type, good_subtype from reviews
    union select comment_id, product_sku, comment_text, null, name, good_type, good_subtype from conv_reviews
    where trim(comment_text) <> '') x""")
def merged_sources(v: Views) -> DataFrame:
    other = A.nonblank_rows(v.conv_reviews(), "comment_text").withColumnRenamed("name", "speaker")
    return A.merge_sources(v.reviews(), other, drop=["comment_id", "good_type", "good_subtype"]).select(
        "product_sku", "comment_text", "name", "speaker"
    )


@query("category_slice", ("reviews",), """select comment_id, product_sku as sku, comment_text from reviews where good_type = 'en'""")
def category_slice(v: Views) -> DataFrame:
    english = v.reviews().where(F.col("good_type") == "en").withColumnRenamed("product_sku", "sku")
    return english.drop("name", "good_type", "good_subtype")


@query("length_report", ("reviews",), """select good_type, count(*) as n_rows, max(n) as max_length,
    cast(sum(case when n > 768 then 1 else 0 end) as bigint) as n_over from (
        select good_type, len(list_filter(string_split(lower(comment_text),' '), lambda t: t <> '')) as n from reviews) x
    group by good_type""")
def length_report(v: Views) -> DataFrame:
    return A.length_report(v.reviews(), F.size(S.blank_tokens("comment_text")).cast("long"), 768, ["good_type"])


# -- samples and splits ---------------------------------------------------------------------------------------


@query("sample_per_type", ("reviews",), f"""select comment_id, product_sku, good_type from (
    select *, row_number() over (partition by good_type order by md5(concat('{SEED}|', comment_id))) as r from reviews) x
    where r <= 150""")
def sample_per_type(v: Views) -> DataFrame:
    return O.sample_per_type(v.reviews(), 150, SEED).select("comment_id", "product_sku", "good_type")


@query("downsampled", ("products",), f"""select product_sku, good_type from products where product_sku not in (
    select product_sku from (
        select product_sku, row_number() over (order by md5(concat('{SEED}|', product_sku))) as r, count(*) over () as n
        from products where good_type = '1-URGENT') x where r <= floor(n / 1.5))""")
def downsampled(v: Views) -> DataFrame:
    return O.downsample_category(v.products(), "1-URGENT", 1.5, SEED).select("product_sku", "good_type")


@query("shuffled_top", ("reviews", "products"), f"""select * from (select 'random' as kind, cast(comment_id as varchar) as id from reviews
    order by md5(concat('{SEED}|', comment_id)) limit 100)
    union all select * from (select 'first' as kind, cast(product_sku as varchar) as id from products order by product_sku limit 5)""")
def shuffled_top(v: Views) -> DataFrame:
    random = O.sample_rows(v.reviews().select("comment_id"), 100, "comment_id", SEED)
    first = O.first_products(v.products(), 5)
    return random.select(F.lit("random").alias("kind"), F.col("comment_id").cast("string").alias("id")).unionByName(
        first.select(F.lit("first").alias("kind"), F.col("product_sku").cast("string").alias("id"))
    )


def split_sql(source: str, key: str, strat: str, test: float = 0.1, val: float = 0.1) -> dict:
    """CTE ``split`` (key, stratum, split) of a table with at least ten rows and two strata."""
    def share(total: str, size: str, out: str, src: str) -> str:
        return f"""select *, fl + case when row_number() over (order by round(sh - fl, 9) desc, st) <= {total} - sum(fl) over ()
            then 1 else 0 end as {out} from (select *, {total} * {size} / sum({size}) over () as sh,
            floor({total} * {size} / sum({size}) over ()) as fl from {src}) q"""

    frac = val / (1.0 - test)
    return {
        "strata": ([source], f"select {strat} as st, count(*) as size from {source} group by 1 having count(*) >= 3"),
        "quota_test": (["strata"], share(f"(select ceil({test}::double * sum(size)) from strata)", "size", "n_test", "strata")),
        "left_over": (["quota_test"], "select st, size, n_test, size - n_test as rest from quota_test"),
        "quota_val": (["left_over"], share(f"(select ceil({frac!r}::double * sum(rest)) from left_over)", "rest", "n_val", "left_over")),
        "split": (["quota_val"], f"""select s.{key}, s.{strat}, case when r <= n_test then 'test' when r <= n_test + n_val then 'val'
            else 'train' end as split from (select {key}, {strat},
            row_number() over (partition by {strat} order by md5(concat('{SEED}|', {key}))) as r from {source}) s
            left join quota_val on st = s.{strat}"""),
    }


PRODUCT_SPLIT = split_sql("products", "product_sku", "good_type")
DOC_SPLIT = {
    "docs": ([], "select doc_id as product_sku, lang as good_type from documents"),
    **split_sql("docs", "product_sku", "good_type"),
}


@query("stratified_split", ("split",), "select product_sku, good_type, split from split", PRODUCT_SPLIT)
def stratified_split(v: Views) -> DataFrame:
    return O.stratified_split(v.products(), seed=SEED)


@query("fixed_split", ("products",), f"""select product_sku, good_type, case when row_number() over (
    order by md5(concat('{SEED}|', product_sku))) <= 1600 then 'train' else 'val' end as split from products""")
def fixed_split(v: Views) -> DataFrame:
    return O.fixed_split(v.products(), 1600, seed=SEED)


# -- cells and tags -------------------------------------------------------------------------------------------


@query("parse_list_cells", ("cells",), """select id,
    case when cell is null then 0 when id % 5 in (0,1) then len(string_split(p_name,' ')) else 1 end::int as n_loose,
    case id % 5 when 0 then replace(p_name,' ','|') when 1 then replace(p_name,' ','|') when 2 then p_name else '' end as loose,
    case id % 5 when 0 then replace(p_name,' ','|') when 1 then cell when 2 then p_name else '' end as strict,
    case id % 5 when 3 then '[]' when 4 then '[""]' when 2 then concat('["', p_name, '"]')
        else concat('["', replace(p_name,' ','","'), '"]') end as json
    from cells""")
def parse_list_cells(v: Views) -> DataFrame:
    loose = T.parse_list("cell")
    return v.cells().select(
        "id", F.size(loose).alias("n_loose"), F.array_join(loose, "|").alias("loose"),
        F.array_join(T.parse_reviews_json("cell"), "|").alias("strict"), F.to_json(loose).alias("json"),
    )


@query("parse_tags", ("tagged",), """select product_sku, good_type, len(t)::int as n_tags, array_to_string(t,'; ') as tags,
    lower(array_to_string(t,'; ')) as tags_lower from (
    select *, list_filter(list_transform(string_split(tags,';'), lambda x: trim(x)), lambda x: x <> '') as t from tagged
    where trim(tags) <> '') x""")
def parse_tags(v: Views) -> DataFrame:
    tags = T.parse_tags("tags")
    return A.nonblank_rows(v.tagged()).select(
        "product_sku", "good_type", F.size(tags).alias("n_tags"), T.join_tags(tags).alias("tags"),
        T.join_tags(T.parse_tags("tags", lower=True)).alias("tags_lower"),
    )


@query("tag_pools", ("tag_cells",), """select good_type, string_agg(tag, '; ' order by tag) as tags
    from (select distinct good_type, lower(tag) as tag from tag_cells) x group by good_type""")
def tag_pools(v: Views) -> DataFrame:
    return P.pool_rows(P.build_tag_pools(v.tagged()))


@query("tag_pool_sizes", ("doc_labels",), "select good_type, count(distinct tag) as n_tags from doc_labels group by good_type")
def tag_pool_sizes(v: Views) -> DataFrame:
    return P.pool_sizes(P.build_tag_pools(v.doc_tags()))


@query("pool_roundtrip", ("tag_cells",), "select distinct good_type, lower(tag) as tag from tag_cells")
def pool_roundtrip(v: Views) -> DataFrame:
    return TB.read_tag_pool(P.pool_rows(P.build_tag_pools(v.tagged()), per_row=4))


@query("tag_profile", ("doc_labels",), """select count(*)::bigint as n_products, round(avg(n), 6) as mean_tags,
    quantile_cont(n, 0.5) as median_tags, round(quantile_cont(n, 0.9), 6) as p90_tags,
    round(avg(case when n = 0 then 1.0 else 0.0 end), 6) as untagged_share,
    (select count(distinct tag) from doc_labels) as n_tags,
    (select quantile_cont(c, 0.5) from (select count(*) as c from doc_labels group by tag)) as median_frequency,
    round((select sum(c) from (select count(*) as c from doc_labels group by tag order by c desc, tag limit 50))::double
        / (select count(*) from doc_labels), 6) as top_coverage
    from (select d.doc_id, count(l.tag)::double as n from documents d left join doc_labels l on l.product_sku = d.doc_id
    group by d.doc_id) x""")
def tag_profile(v: Views) -> DataFrame:
    docs = v.doc_tags()
    profile = P.tag_profile(docs.select("product_sku"), L.long_tags(docs))
    return profile.withColumns({c: r6(c) for c in ("mean_tags", "p90_tags", "untagged_share", "top_coverage")})


@query("tag_mapping", ("mapping",), """select good_type, old_tag, arg_max(new_tag, ord) as new_tag from mapping group by all""")
def tag_mapping(v: Views) -> DataFrame:
    return P.latest_rules(TB.read_tag_mapping(TB.mapping_rows(v.mapping()), order="ord"))


@query("tag_mapping_files", ("mapping",), """select good_type, old_tag, arg_max(new_tag, k) as new_tag from (
    select good_type, old_tag, new_tag, ord as k from mapping union all
    select good_type, old_tag, 'later', 1000 from mapping where old_tag in ('hot', 'red')) x group by all""")
def tag_mapping_files(v: Views) -> DataFrame:
    # Two files, the second with its columns in another order: its rules come later and win.
    path = _fresh(v, "mapping-csv")
    rows = TB.mapping_rows(v.mapping())
    first = rows.repartition(1).sortWithinPartitions("ord", "old_tags").drop("ord")
    late = rows.where(F.col("old_tags").isin("hot", "red")).select(F.lit("later").alias("new_tag"), "good_type", "old_tags")
    TB.write_table(first, f"{path}/1", "csv")
    TB.write_table(late.repartition(1), f"{path}/2", "csv")
    return P.latest_rules(TB.read_tag_mapping(v.spark, f"{path}/*"))


CHAIN_SQL = {
    # A chain of 45 links, one that joins it, a cycle of three and a rule that leads into the cycle.
    "links": (["mapping"], """select distinct good_type, concat('n', i) as old_tag, concat('n', i + 1) as new_tag from mapping, range(0, 45) r(i)
        union select distinct good_type, 'side', 'n7' from mapping
        union select distinct good_type, a, b from mapping, (values ('c1','c2'), ('c2','c3'), ('c3','c1'), ('in','c3')) x(a, b)
        union select good_type, old_tag, arg_max(new_tag, ord) from mapping group by all"""),
    "steps": (["links"], """select good_type, old_tag, new_tag, [old_tag] as seen from links
        union all select s.good_type, s.old_tag, l.new_tag, list_append(s.seen, s.new_tag) from steps s
        join links l on l.good_type = s.good_type and l.old_tag = s.new_tag where not list_contains(s.seen, s.new_tag)"""),
    "ends": (["steps", "links"], """select good_type, old_tag, new_tag, seen from steps s where list_contains(seen, new_tag)
        or not exists (select 1 from links l where l.good_type = s.good_type and l.old_tag = s.new_tag)"""),
}


@query("tag_mapping_chains", ("ends",), """select good_type, old_tag, target as new_tag from (
    select good_type, old_tag, case when list_contains(seen, new_tag)
        then list_min(seen[list_position(seen, new_tag):]) else new_tag end as target from ends) x where old_tag <> target""", CHAIN_SQL)
def tag_mapping_chains(v: Views) -> DataFrame:
    extra = [(f"n{i}", f"n{i + 1}") for i in range(45)] + [("side", "n7"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("in", "c3")]
    links = F.array(*[F.struct(F.lit(a).alias("old_tag"), F.lit(b).alias("new_tag")) for a, b in extra])
    return P.resolve_chains(P.latest_rules(v.mapping()).unionByName(v.types().select("good_type", F.inline(links))))


REWRITE = {
    "raw_lists": (["tag_cells"], """select product_sku, string_agg(tag, '; ' order by pos) as tags, count(*) as n from (
        select product_sku, tag, min(pos) as pos from (
            select *, row_number() over (partition by product_sku order by ord1, ord2, i) as pos from tag_cells)
        group by all) group by product_sku"""),
    "rules": (["mapping"], "select good_type, old_tag, arg_max(new_tag, ord) as new_tag from mapping group by all"),
    "rewritten": (["tag_cells", "rules", "allowed", "tagged"], """select p.product_sku,
        coalesce(string_agg(x.tag, '; ' order by x.pos), '') as tags, count(x.tag) as n
        from (select distinct product_sku from tagged) p left join (
            select product_sku, tag, min(pos) as pos from (
                select c.product_sku, c.good_type, coalesce(r.new_tag, lower(c.tag)) as tag,
                    row_number() over (partition by c.product_sku order by ord1, ord2, i) as pos
                from tag_cells c left join rules r on r.good_type = c.good_type and r.old_tag = lower(c.tag)) m
            where exists (select 1 from allowed a where a.good_type = m.good_type and a.label = m.tag)
            group by all) x on x.product_sku = p.product_sku group by p.product_sku"""),
}


def _rewritten(v: Views) -> DataFrame:
    pool = v.allowed().withColumnRenamed("label", "tag")
    return P.rewrite_tags(v.tagged(), v.mapping(), pool, order_by=ORDER)


@query("rewrite_tags", ("rewritten",), "select product_sku, tags from rewritten", REWRITE)
def rewrite_tags(v: Views) -> DataFrame:
    return _rewritten(v).select("product_sku", T.join_tags("tags").alias("tags"))


@query("rewrite_report", ("rewritten", "raw_lists"), """select *, round(100 * (1 - tags_after::double / tags_before), 6) as reduction_pct
    from (select (select count(*) from raw_lists) as rows_before, (select sum(n)::bigint from raw_lists) as tags_before,
    (select count(*) from rewritten where n > 0) as rows_after, (select sum(n)::bigint from rewritten) as tags_after) x""", REWRITE)
def rewrite_report(v: Views) -> DataFrame:
    before = A.product_tags(v.tagged(), order_by=ORDER)
    return P.rewrite_report(before, _rewritten(v)).withColumn("reduction_pct", r6("reduction_pct"))


@query("ci_dedupe", ("tag_cells",), """select product_sku, string_agg(tag, '; ' order by pos) as tags from (
    select product_sku, arg_min(tag, pos) as tag, min(pos) as pos from (
        select *, row_number() over (partition by product_sku order by ord1, ord2, i) as pos from tag_cells) x
    group by product_sku, lower(tag)) y group by product_sku""")
def ci_dedupe(v: Views) -> DataFrame:
    lists = A.union_lists(v.tagged(), T.parse_tags("tags"), order_by=ORDER, ignore_case=True)
    return lists.select("product_sku", T.join_tags("tags").alias("tags"))


# -- labels and priors ----------------------------------------------------------------------------------------

VOCAB_SQL = {
    **DOC_SPLIT,
    "doc_vocab": (["doc_labels", "split"], """select tag as label, count(*) as n,
        cast(row_number() over (order by tag) - 1 as int) as label_id
        from doc_labels join split using (product_sku) where split = 'train' group by tag having count(*) >= 3"""),
}


def _split_doc_tags(v: Views) -> DataFrame:
    docs = v.doc_tags()
    split = O.stratified_split(docs.select("product_sku", "good_type"), seed=SEED).select("product_sku", "split")
    # The split meets whole documents: their tags are many times as many rows.
    return L.long_tags(docs.join(split, "product_sku"), carry=["split"])


@query("label_vocab", ("doc_vocab",), "select label_id, label, n from doc_vocab", VOCAB_SQL)
def label_vocab(v: Views) -> DataFrame:
    return L.apply_label_vocab(_split_doc_tags(v), 3)[1].select("label_id", "label", "n")


@query("label_vocab_rows", ("doc_vocab",), """select product_sku, split, count(*) as n_labels from doc_labels
    join split using (product_sku) join doc_vocab on label = tag group by all""", VOCAB_SQL)
def label_vocab_rows(v: Views) -> DataFrame:
    rows, _ = L.apply_label_vocab(_split_doc_tags(v), 3)
    return rows.groupBy("product_sku", "split").agg(F.count(F.lit(1)).alias("n_labels"))


@query("multi_hot", ("truth", "vocab", "products"), """select p.product_sku, string_agg(case when t.label is null then '0' else '1' end,
    '' order by v.label) as hot from products p cross join vocab v
    left join truth t on t.product_sku = p.product_sku and t.label = v.label group by p.product_sku""")
def multi_hot(v: Views) -> DataFrame:
    tags = A.product_tags(v.tagged(), order_by=ORDER, lower=True).withColumn("_v", R.vocab_array(v.vocab()))
    hot = L.multi_hot_vector("tags", F.col("_v"))
    return tags.select("product_sku", F.array_join(hot.cast("array<string>"), "").alias("hot"))


STATS_SQL = {
    "stats": (["truth", "products"], """select p.good_type, label, count(*) as pos, max(n) as n from truth t
        join (select good_type, count(*) as n from products group by 1) p on p.good_type = t.good_type group by 1, 2
        union all select null, label, count(*), (select count(*) from products) from truth group by label"""),
    "priors": (["stats", "vocab"], """select g.good_type, v.label, coalesce(s.pos, 0) as pos, g.n,
        ln((p.x) / (1 - p.x)) as prior_logit
        from (select good_type, max(n) as n from stats group by 1) g cross join vocab v
        left join stats s on s.good_type is not distinct from g.good_type and s.label = v.label,
        lateral (select least(greatest((coalesce(s.pos, 0) + 1.0::double) / (g.n + 2.0::double), 1e-6::double), 1 - 1e-6::double) as x) p"""),
}


def _stats(v: Views) -> DataFrame:
    return R.category_label_stats(v.truth(), v.products())


def _priors(v: Views) -> DataFrame:
    return R.category_priors(_stats(v), v.vocab())


@query("label_stats", ("stats",), "select * from stats", STATS_SQL)
def label_stats(v: Views) -> DataFrame:
    return _stats(v)


@query("category_priors", ("priors",), "select good_type, label, round(prior_logit, 6) as prior_logit from priors", STATS_SQL)
def category_priors(v: Views) -> DataFrame:
    return _priors(v).withColumn("prior_logit", r6("prior_logit"))


@query("priors_from_reviews", ("priors",), "select good_type, label, round(prior_logit, 6) as prior_logit from priors", {
    **STATS_SQL, "truth": (["tag_cells", "vocab"], "select distinct product_sku, good_type, lower(tag) as label from tag_cells where lower(tag) in (select label from vocab)"),
    "products": (["tag_cells"], "select distinct product_sku, good_type from tag_cells")})
def priors_from_reviews(v: Views) -> DataFrame:
    out = tagging.priors_from_reviews(v.tagged(), v.vocab(), order_by=ORDER)
    return out.withColumn("prior_logit", r6("prior_logit"))


BASELINE_SQL = {
    **STATS_SQL,
    "ranked": (["priors"], "select *, row_number() over (partition by good_type order by pos desc, label) as r from priors"),
    "guesses": (["ranked", "products"], """select k, product_sku, r.label from products p
        join ranked r on r.good_type = p.good_type, (values (2),(3)) as ks(k) where r.r <= k"""),
}


@query("category_topk", ("ranked",), "select good_type, label, r::int as rank from ranked where r <= 3", BASELINE_SQL)
def category_topk(v: Views) -> DataFrame:
    return R.category_topk(_stats(v), v.vocab(), 3)


@query("category_baseline", ("guesses", "truth"), """select k, round(2.0 * hit / (n_pred + (select count(*) from truth)), 6) as micro_f1,
    round(n_pred::double / (select count(*) from products), 6) as avg_pred_tags from (
    select k, count(*)::double as n_pred, count(t.label)::double as hit from guesses g
    left join truth t on t.product_sku = g.product_sku and t.label = g.label group by k) x""", BASELINE_SQL)
def category_baseline(v: Views) -> DataFrame:
    report = tagging.baseline_report(v.products(), v.truth(), _stats(v), v.vocab())
    return report.withColumns({"micro_f1": r6("micro_f1"), "avg_pred_tags": r6("avg_pred_tags")})


# -- scores to tags -------------------------------------------------------------------------------------------


@query("max_pool", ("scores",), "select product_sku, good_type, label, round(prob, 6) as prob from scores")
def max_pool(v: Views) -> DataFrame:
    return v.scores().withColumn("prob", r6("prob"))


CALIBRATED_SQL = {
    **STATS_SQL,
    # Category rows of one type are left out, so that it takes the global prior.
    "blended": (["scores", "priors"], f"""select s.product_sku, s.good_type, s.label, 1 / (1 + exp(-(
        ln(c.p / (1 - c.p)) + coalesce(o.prior_logit, g.prior_logit)))) as prob from scores s
        left join priors o on o.good_type = s.good_type and o.label = s.label and o.good_type <> '{UNLISTED_TYPE}'
        left join priors g on g.good_type is null and g.label = s.label,
        lateral (select least(greatest(s.prob, 1e-6::double), 1 - 1e-6::double) as p) c"""),
    "unfallen": (["scores", "priors"], f"""select s.product_sku, s.good_type, s.label, case when o.prior_logit is null then s.prob
        else 1 / (1 + exp(-(ln(c.p / (1 - c.p)) + o.prior_logit))) end as prob from scores s
        left join priors o on o.good_type = s.good_type and o.label = s.label and o.good_type <> '{UNLISTED_TYPE}',
        lateral (select least(greatest(s.prob, 1e-6::double), 1 - 1e-6::double) as p) c"""),
    "masked": (["unfallen", "allowed"], """select b.product_sku, b.good_type, b.label, b.prob * case
        when a.label is not null or b.good_type not in (select good_type from allowed) then 1 else 0 end as prob
        from unfallen b left join allowed a on a.good_type = b.good_type and a.label = b.label"""),
}


def _partial_priors(v: Views) -> DataFrame:
    return _priors(v).where(F.col("good_type").isNull() | (F.col("good_type") != UNLISTED_TYPE))


def _stored(df: DataFrame) -> DataFrame:
    """A fitted artifact as it is used in practice: a stored table whose size is known, so that joining it to the
    scores needs no shuffle of the scores when it is small."""
    return durable(df)


@query("prior_blend", ("blended",), "select product_sku, good_type, label, round(prob, 6) as prob from blended", CALIBRATED_SQL)
def prior_blend(v: Views) -> DataFrame:
    return C.blend_prior(v.scores(), _stored(_partial_priors(v))).select("product_sku", "good_type", "label", r6("prob").alias("prob"))


@query("allow_mask", ("scores", "allowed"), """select s.product_sku, s.good_type, s.label, round(s.prob, 6) as prob from scores s
    left join allowed a on a.good_type = s.good_type and a.label = s.label
    where a.label is not null or s.good_type not in (select good_type from allowed)""")
def allow_mask(v: Views) -> DataFrame:
    masked = C.apply_allow_list(v.scores(), _stored(v.allowed()))
    return masked.where(F.col("prob") > 0).select("product_sku", "good_type", "label", r6("prob").alias("prob"))


def _choose_sql(source: str, k: int) -> str:
    return f"""select product_sku, good_type, label, prob, rank from (select s.product_sku, s.good_type, s.label, s.prob,
        s.prob >= t.threshold as passed, cast(row_number() over (partition by s.product_sku
        order by s.prob >= t.threshold desc, s.prob desc, s.label) as int) as rank
        from {source} s join thresholds t on t.label = s.label) x where rank <= {k} and (passed or rank = 1)"""


CHOSEN_SQL = {
    **CALIBRATED_SQL,
    "chosen": (["scores", "thresholds"], _choose_sql("scores", 8)),
    "predicted": (["masked", "thresholds"], _choose_sql("masked", 8)),
}


@query("binarize", ("scores", "thresholds"), """select product_sku, cast(count(*) as bigint) as n_passed from scores
    join thresholds using (label) where prob >= threshold group by product_sku""")
def binarize(v: Views) -> DataFrame:
    return C.binarize(v.scores(), v.thresholds()).where("passed").groupBy("product_sku").agg(F.count(F.lit(1)).alias("n_passed"))


@query("select_tags", ("chosen",), "select product_sku, good_type, label, round(prob, 6) as prob, rank from chosen", CHOSEN_SQL)
def select_tags(v: Views) -> DataFrame:
    return C.select_tags(v.scores(), v.thresholds()).withColumn("prob", r6("prob"))


@query("select_tags_by_prob", ("scores",), """select product_sku, label, rank from (select *, cast(row_number() over (
    partition by product_sku order by prob desc, label) as int) as rank, sum(case when prob >= 0.5 then 1 else 0 end)
    over (partition by product_sku) as n from scores) x where case when n > 3 then rank <= 3 when n = 0 then rank = 1 else prob >= 0.5 end""")
def select_tags_by_prob(v: Views) -> DataFrame:
    return C.select_tags(v.scores(), 0.5, top_k=3, mode="by_prob").select("product_sku", "label", "rank")


@query("predict_tags", ("predicted",), "select product_sku, good_type, label, round(prob, 6) as prob, rank from predicted", CHOSEN_SQL)
def predict_tags(v: Views) -> DataFrame:
    artifacts = AR.Artifacts(
        v.vocab(), _stored(v.thresholds()), _stored(v.allowed()), _stored(_partial_priors(v)), category_prior_weight=1.0
    )
    return tagging.predict_from_scores(v.chunk_scores(), artifacts).withColumn("prob", r6("prob"))


def words_scorer(batches):
    """Stand-in for a model that reads the text: the share of a label's letters in the window, each distinct letter once."""
    import pandas as pd

    labels = ("roomy", "the", "en", "quality")
    for pdf in batches:
        rows = [
            (sku, kind, int(chunk), label, sum(c in window for c in set(label)) / len(set(label)) if label != "the" else float(" the " in window))
            for sku, kind, chunk, window in zip(pdf["product_sku"], pdf["good_type"], pdf["chunk_id"], pdf["text"])
            for label in labels
        ]
        yield pd.DataFrame(rows, columns=["product_sku", "good_type", "chunk_id", "label", "prob"])


WORDS_SQL = {
    "word_labels": ([], "select * from (values ('roomy', 'roomy'), ('the', ''), ('en', 'en'), ('quality', 'quality')) l(label, letters)"),
    "word_scores": (["product_texts", "word_labels"], """select product_sku, good_type, label, case when label = 'the'
        then case when contains(text, ' the ') then 1.0::double else 0.0::double end
        else len(list_filter(list_distinct(string_split(letters, '')), lambda c: contains(text, c)))::double / len(list_distinct(string_split(letters, ''))) end as prob
        from product_texts, word_labels"""),
    "word_choice": (["word_scores"], """select * from (select product_sku, good_type, label, prob, prob >= 0.9 as passed, cast(row_number() over (
        partition by product_sku order by prob >= 0.9 desc, prob desc, label) as int) as rank from word_scores) x where rank <= 3 and (passed or rank = 1)"""),
}


@query("predict_with_scorer", ("word_choice",), "select product_sku, good_type, label, round(prob, 6) as prob, rank from word_choice",
       {**PRODUCT_SQL, **WORDS_SQL})
def predict_with_scorer(v: Views) -> DataFrame:
    texts = A.aggregate_products(v.reviews()).select("product_sku", "good_type", "text", F.lit(0).alias("chunk_id"))
    labels = v.spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("roomy", "the", "en", "quality")])).alias("label"))
    thresholds = labels.select("label", F.lit(0.9).alias("threshold"))
    artifacts = AR.Artifacts(labels, AR.threshold_table(thresholds, v.spark.range(1).select(F.lit(0.9).alias("threshold"))), top_k=3)
    return tagging.predict_tags(texts, words_scorer, artifacts).withColumn("prob", r6("prob"))


LONG_SQL = {
    **PRODUCT_SQL,
    "word_labels": WORDS_SQL["word_labels"],
    "text_tokens": (["product_texts"], """select product_sku, good_type, list_filter(string_split(lower(text), ' '), lambda t: t <> '') as tokens from product_texts"""),
    "text_windows": (["text_tokens"], """select product_sku, good_type, array_to_string(tokens[c.i * 126 + 1 : c.i * 126 + 254], ' ') as text from text_tokens,
        lateral (select unnest(range(0, 1 + greatest(0, ceil((len(tokens) - 254) / 126.0))::int)) as i) c"""),
    "window_scores": (["text_windows", "word_labels"], WORDS_SQL["word_scores"][1].replace("product_texts", "text_windows")),
    "word_scores": (["window_scores"], "select product_sku, good_type, label, max(prob) as prob from window_scores group by all"),
    "word_choice": WORDS_SQL["word_choice"],
}


@query("predict_long", ("word_choice",), "select product_sku, good_type, label, round(prob, 6) as prob, rank from word_choice", LONG_SQL)
def predict_long(v: Views) -> DataFrame:
    labels = v.spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("roomy", "the", "en", "quality")])).alias("label"))
    thresholds = labels.select("label", F.lit(0.9).alias("threshold"))
    artifacts = AR.Artifacts(labels, AR.threshold_table(thresholds, v.spark.range(1).select(F.lit(0.9).alias("threshold"))), top_k=3)
    return tagging.predict_long(v.reviews(), words_scorer, artifacts).withColumn("prob", r6("prob"))


@query("product_leads", ("product_texts",), "select product_sku, substr(text, 1, 2000) as text from product_texts", PRODUCT_SQL)
def product_leads(v: Views) -> DataFrame:
    return X.lead_text(A.product_text_chunks(v.reviews()), 2000)


PREPARED_SQL = {
    **PRODUCT_SPLIT,
    "exact_tags": (["tag_cells"], "select distinct product_sku, good_type, tag from tag_cells"),
    "kept_tags": (["exact_tags", "split"], """select tag as label, cast(row_number() over (order by tag) - 1 as int) as label_id
        from exact_tags join split using (product_sku) where split = 'train' group by tag having count(*) >= 3"""),
}


@query("prepare_dataset", ("exact_tags", "kept_tags", "split"), """select x.product_sku, x.good_type, split, label, label_id from exact_tags x
    join split s on s.product_sku = x.product_sku join kept_tags k on k.label = x.tag""", PREPARED_SQL)
def prepare_dataset(v: Views) -> DataFrame:
    rows = v.tagged().withColumn("comment_text", F.lit("fine"))
    data = tagging.prepare_dataset(rows, order_by=ORDER, seed=SEED)
    return L.with_label_ids(data.truth, data.vocab).select("product_sku", "good_type", "split", "label", "label_id")


@query("default_attributes", ("reviews",), """select product_sku, '' as name, min(good_type) as good_type, '' as good_subtype, concat_ws(' | ',
    trim(min(good_type)), string_agg(comment_text, ' ' order by comment_id)) as text from reviews group by product_sku""")
def default_attributes(v: Views) -> DataFrame:
    return A.aggregate_products(v.reviews().drop("name", "good_subtype")).select("product_sku", *A.ATTRS, "text")


@query("prediction_lists", ("chosen",), """select product_sku, good_type,
    string_agg(concat(label, '=', format('{:.3f}', prob)), '; ' order by rank) as tags from chosen group by all""", CHOSEN_SQL)
def prediction_lists(v: Views) -> DataFrame:
    lists = C.prediction_lists(C.select_tags(v.scores(), v.thresholds()))
    text = F.transform("tags", lambda x: F.concat(x["tag"], F.lit("="), T.score_text(x["score"])))
    return lists.select("product_sku", "good_type", T.join_tags(text).alias("tags"))


# -- reranking and replies ------------------------------------------------------------------------------------

RERANK_TEMPLATE = "Category: {good_type}\nText: {text}\n{candidates}\nAt most {max_return}."
RERANK_SQL = {
    **CHOSEN_SQL,
    "cand": (["scores"], """select * from (select *, row_number() over (partition by product_sku order by prob desc, label) as r
        from scores) x where r <= 20 and prob > 0"""),
    "cand_lists": (["cand"], """select product_sku, good_type, arg_min(label, r) as l1, arg_max(label, r) as l2, arg_max(prob, r) as p2,
        string_agg(concat(r, '. ', label, ' (model_prob=', format('{:.3f}', prob), ')'), chr(10) order by r) as lines
        from cand group by product_sku, good_type"""),
    "reranked": (["cand_lists"], """select product_sku, good_type, l1 as label, 0.9::double as prob, 1 as rank from cand_lists where product_sku % 3 < 2
        union all select product_sku, good_type, l2, p2, 2 from cand_lists where product_sku % 3 < 2
        union all select product_sku, good_type, l1, 0.25::double, 3 from cand_lists where product_sku % 3 < 2"""),
}


@query("rerank_candidates", ("cand_lists",), """select product_sku, concat('Category: ', good_type, chr(10), 'Text: order ',
    product_sku, chr(10), lines, chr(10), 'At most 5.') as prompt from cand_lists""", RERANK_SQL)
def rerank_candidates(v: Views) -> DataFrame:
    lists = Q.candidate_lists(v.scores())
    texts = v.products().select("product_sku", F.concat(F.lit("  order "), F.col("product_sku").cast("string"), F.lit(" ")).alias("text"))
    return Q.rerank_prompts(lists, texts, RERANK_TEMPLATE).select("product_sku", "prompt")


def _rerank_replies(scores: DataFrame) -> DataFrame:
    """Synthetic replies: best and last candidate, an unknown tag, odd scores; prose around, a bare list, or no JSON."""
    lists = Q.candidate_lists(scores)
    first, last = F.get("candidates", 0)["tag"], F.element_at("candidates", -1)["tag"]
    items = F.concat(
        F.lit('[{"tag":"'), first, F.lit('","score":0.9},{"tag":"unknown","score":1},"odd",{"tag":"'), last,
        F.lit('","score":"n/a"},{"tag":"'), first, F.lit('","score":"0.25"}]'),
    )
    kind = F.col("product_sku") % 3
    reply = (
        F.when(kind == 0, F.concat(F.lit('Sure:\n{"tags":'), items, F.lit("}\nDone.")))
        .when(kind == 1, items)
        .otherwise("no tags fit")
    )
    return lists.withColumn("reply", reply)


@query("rerank_apply", ("reranked", "chosen"), """select product_sku, good_type, label, round(prob, 6) as prob, rank from reranked
    union all select product_sku, good_type, label, round(prob, 6), rank from chosen
    where product_sku not in (select product_sku from reranked)""", RERANK_SQL)
def rerank_apply(v: Views) -> DataFrame:
    # Made twice: scores lie by product as they are made, and stored ones would have to move for either use.
    scores = v.scores()
    reranked = durable(Q.apply_rerank_replies(_rerank_replies(scores)))
    selected = C.select_tags(scores, _stored(v.thresholds()))
    return Q.prefer_reranked(reranked, selected).withColumn("prob", r6("prob"))


@query("tag_replies", ("tag_cells", "tagged"), """select p.product_sku, coalesce(tags, '') as tags
    from (select distinct product_sku from tagged) p left join (
    select product_sku, string_agg(tag, '; ' order by pos) as tags from (
        select product_sku, arg_min(tag, pos) as tag, min(pos) as pos from (
            select *, row_number() over (partition by product_sku order by ord1, ord2, i) as pos
            from tag_cells where ord1 % 4 <> 3) x group by product_sku, lower(tag)) y group by product_sku) z using (product_sku)""")
def tag_replies(v: Views) -> DataFrame:
    """One reply per order line: fenced, under the other key, inside prose, or without JSON."""
    items = F.to_json(F.concat(F.array(F.lit(" "), F.lit("")), T.parse_tags("tags")))
    kind = F.col("ord1") % 4
    reply = (
        F.when(kind == 0, F.concat(F.lit('```json\n{"tags": ["draft"]}\n```\n```JSON\n{"explanation": "x", "tags": '), items, F.lit("}\n```")))
        .when(kind == 1, F.concat(F.lit('```json {"теги": '), items, F.lit(', "tags": ["other"]} ```')))
        .when(kind == 2, F.concat(F.lit('The tags are {"tags": '), items, F.lit("} as asked")))
        .otherwise("nothing to say")
    )
    merged = Q.merge_tag_replies(v.tagged().withColumn("reply", reply), order_by=ORDER)
    return merged.select("product_sku", T.join_tags("tags").alias("tags"))


@query("pool_replies", ("tag_cells",), """select good_type, 'kept' as kind, lower(tag) as old_tag, '' as new_tag, -1 as ord, 1::bigint as n
    from tag_cells group by all
    union all select good_type, 'rule', lower(tag), 'merged', 0, count(*) from tag_cells group by all
    union all select good_type, 'rule', lower(tag), '', 2, count(*) from tag_cells where i = 1 group by all""")
def pool_replies(v: Views) -> DataFrame:
    """One pool-filter reply per order line: its tags kept and merged, one malformed rule, one deletion."""
    tags = T.parse_tags("tags")
    reply = F.concat(
        F.lit('```json\n{"kept_tags": '), F.to_json(F.concat(tags, F.array(F.lit(" ")))),
        F.lit(', "mappings": [{"old": '), F.to_json(tags), F.lit(', "new": " Merged "}, {"old": "text", "new": "x"}, {"old": ['),
        F.lit('"'), F.get(tags, 0), F.lit('"], "new": ""}]}\n```'),
    )
    kept, rules = P.filter_pool(v.tagged().select("good_type", reply.alias("reply")))
    counted = rules.groupBy("good_type", F.lit("rule").alias("kind"), "old_tag", "new_tag", "ord").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(kept.select(
        "good_type", F.lit("kept").alias("kind"), F.col("tag").alias("old_tag"), F.lit("").alias("new_tag"),
        F.lit(-1).alias("ord"), F.lit(1).cast("long").alias("n"),
    ))


@query("review_chunks")
def review_chunks(v: Views) -> DataFrame:
    size = F.aggregate("reviews", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    chunks = A.review_chunks(v.reviews(), 20000)
    return chunks.select("product_sku", "chunk_id", F.size("reviews").alias("n_reviews"), size.alias("n_chars"))


ORACLES["review_chunks"] = with_views(["numbered", "walk"], """select product_sku, chunk_id, count(*)::int as n_reviews,
    max(used) as n_chars from walk group by all""", {
    "numbered": (["reviews"], """select product_sku, length(comment_text) as n,
        row_number() over (partition by product_sku order by comment_id) as i from reviews"""),
    "walk": (["numbered"], """select product_sku, i, n as used, 0 as chunk_id from numbered where i = 1
        union all select m.product_sku, m.i, case when w.used + m.n > 20000 then m.n else w.used + m.n end,
            case when w.used + m.n > 20000 then w.chunk_id + 1 else w.chunk_id end
        from walk w join numbered m on m.product_sku = w.product_sku and m.i = w.i + 1"""),
})

TAG_TEMPLATE = "Product: {name}\nType: {good_type} / {good_subtype} ({chunk}/{chunks})\n{reviews}"


@query("tag_prompts", ("conv_reviews",), """select product_sku, 0 as chunk_id, concat('Product: ', arg_min(name, comment_id), chr(10), 'Type: ',
    arg_min(good_type, comment_id), ' / ', arg_min(good_subtype, comment_id), ' (1/1)', chr(10),
    string_agg(concat(i, '. ', regexp_replace(comment_text, '^\\s+|\\s+$', '', 'g')), chr(10) order by comment_id)) as prompt from (
    select *, row_number() over (partition by product_sku order by comment_id) as i from conv_reviews) x group by product_sku""")
def tag_prompts(v: Views) -> DataFrame:
    return Q.tag_prompts(v.conv_reviews(), TAG_TEMPLATE)


def echo_client():
    """Stand-in for a text-generating service: the first word of every numbered review as tags."""
    import json
    import re

    def send(prompt: str) -> str:
        words = re.findall(r"(?am)^\d+\. ([^\s]+)", prompt)
        return "```json\n" + json.dumps({"explanation": "", "tags": words + [w.upper() for w in words[:1]]}) + "\n```"

    return send


@query("tag_with_client", ("conv_reviews",), """select product_sku, string_agg(w, '; ' order by i) as tags from (
    select product_sku, arg_min(w, comment_id) as w, min(comment_id) as i from (
        select product_sku, comment_id, regexp_extract(comment_text, '[^\\s]+') as w from conv_reviews) x group by product_sku, lower(w)) y
    group by product_sku""")
def tag_with_client(v: Views) -> DataFrame:
    tags = Q.tag_with_client(v.conv_reviews(), echo_client, TAG_TEMPLATE, tasks=8, threads=4)
    return tags.select("product_sku", T.join_tags("tags").alias("tags"))


@query("pending", ("conv_reviews",), """select product_sku, case k when 0 then 'old' when 1 then 'new' when 2 then 'new' else 'new' end as tags,
    k > 0 as was_pending from (select product_sku, min(comment_id) // 1000 % 4 as k from conv_reviews group by 1) x""")
def pending(v: Views) -> DataFrame:
    stored = A.group_reviews(v.conv_reviews()).withColumn("_k", F.floor(F.get("comment_id", 0) / 1000) % 4)
    marks = F.when(F.col("_k") == 0, "old").when(F.col("_k") == 1, "").when(F.col("_k") == 2, Q.FAILED_MARK)
    stored = stored.withColumn("tags", marks)
    todo = Q.pending_products(stored)
    done = Q.write_back_tags(stored, todo.select("product_sku", F.lit("new").alias("tags")))
    flag = todo.select("product_sku", F.lit(True).alias("_p"))
    # Nothing is pending a second time.
    left = Q.resume(Q.pending_products(done), flag)
    return done.join(flag, "product_sku", "left").join(left.select("product_sku"), "product_sku", "left_anti").select(
        "product_sku", "tags", F.coalesce("_p", F.lit(False)).alias("was_pending")
    )


@query("resumed_output", ("conv_reviews",), """select product_sku, count(*) as n_comments, sum(length(comment_text))::bigint as n_chars
    from conv_reviews group by product_sku""")
def resumed_output(v: Views) -> DataFrame:
    """A job over the first turns' rows, then one over all: it makes the parts whose input has changed anew and leaves the others."""
    path = f"{shared_folder(v.spark)}/resumed-{uuid.uuid4().hex}"

    def work(rows: DataFrame) -> DataFrame:
        return rows.groupBy("product_sku").agg(F.count(F.lit(1)).alias("n_comments"), F.sum(F.length("comment_text")).alias("n_chars"))

    rows = v.conv_reviews().select("product_sku", "comment_id", "comment_text")
    RS.write_by_parts(rows.where("comment_id % 1000 = 0"), work, path, parts=8, batches=1)
    return RS.write_by_parts(rows, work, path, parts=8, batches=2)


# -- metrics --------------------------------------------------------------------------------------------------

METRIC_SQL = {
    **CHOSEN_SQL,
    "counts": (["chosen", "truth", "vocab"], """select v.label, count(*) filter (p and y) as tp, count(*) filter (p and not y) as fp,
        count(*) filter (y and not p) as fn from vocab v left join (
        select coalesce(c.label, t.label) as label, c.label is not null as p, t.label is not null as y
        from chosen c full join truth t on t.product_sku = c.product_sku and t.label = c.label) o on o.label = v.label group by v.label"""),
}


def _chosen(v: Views) -> DataFrame:
    return C.select_tags(v.scores(), v.thresholds())


@query("micro_macro_f1", ("counts",), """select round(sum(tp) / sum(tp + fp), 6) as micro_precision, round(sum(tp) / sum(tp + fn), 6) as micro_recall,
    round(2 * sum(tp) / sum(2 * tp + fp + fn), 6) as micro_f1,
    round(avg(case when 2 * tp + fp + fn = 0 then 0 else 2.0 * tp / (2 * tp + fp + fn) end), 6) as macro_f1,
    round((select count(*) from chosen)::double / (select count(*) from products), 6) as avg_pred_tags from counts""", METRIC_SQL)
def micro_macro_f1(v: Views) -> DataFrame:
    out = M.multilabel_metrics(_chosen(v), v.truth(), v.vocab(), products=v.products())
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("avg_predicted_tags", ("chosen", "products"), """select p.good_type, round(count(c.label)::double / count(distinct p.product_sku), 6) as avg_pred_tags
    from products p left join chosen c on c.product_sku = p.product_sku group by p.good_type""", METRIC_SQL)
def avg_predicted_tags(v: Views) -> DataFrame:
    return M.avg_predicted_tags(_chosen(v), v.products(), ["good_type"]).withColumn("avg_pred_tags", r6("avg_pred_tags"))


@query("label_counts", ("counts",), "select label, tp, fp, fn from counts", METRIC_SQL)
def label_counts(v: Views) -> DataFrame:
    return M.label_counts(_chosen(v), v.truth())


@query("subset_accuracy", ("scores", "truth"), """select good_type, round(avg(case when same then 1.0 else 0.0 end), 6) as subset_accuracy,
    count(*) as n_products from (select s.product_sku, s.good_type, bool_and((s.prob >= 0.55) = (t.label is not null)) as same from scores s
    left join truth t on t.product_sku = s.product_sku and t.label = s.label group by 1, 2) x group by good_type""")
def subset_accuracy(v: Views) -> DataFrame:
    pred = C.binarize(v.scores(), 0.55).where("passed")
    return M.subset_accuracy(pred, v.truth(), v.products(), ["good_type"]).withColumn("subset_accuracy", r6("subset_accuracy"))


@query("precision_at_k", ("scores", "truth"), """select k, round(avg(hits / k), 6) as precision, round(avg(hits / n_true), 6) as recall from (
    select k, s.product_sku, count(t.label)::double as hits, max(n_true) as n_true from (
        select *, row_number() over (partition by product_sku order by prob desc, label) as r from scores) s
    join (select product_sku, count(*) as n_true from truth group by 1) n on n.product_sku = s.product_sku
    join (values (1),(3),(5)) ks(k) on s.r <= k
    left join truth t on t.product_sku = s.product_sku and t.label = s.label group by 1, 2) x group by k""")
def precision_at_k(v: Views) -> DataFrame:
    return M.precision_recall_at_k(v.scores(), v.truth(), [1, 3, 5]).select(
        "k", r6("precision").alias("precision"), r6("recall").alias("recall")
    )


TUNE_SQL = {
    "pairs": (["scores", "truth"], """select s.label, s.prob, case when t.label is null then 0 else 1 end as y from scores s
        left join truth t on t.product_sku = s.product_sku and t.label = s.label"""),
    "grid37": ([], "select i, 0.05::double + i * ((0.95::double - 0.05::double) / 36) as thr from range(0, 37) r(i)"),
    "grid19": ([], "select i, 0.05::double + i * ((0.95::double - 0.05::double) / 18) as thr from range(0, 19) r(i)"),
    "tuned": (["pairs", "grid37"], """select thr as threshold, f1 from (select i, thr, 2.0 * sum(case when prob >= thr then y else 0 end)
        / (sum(case when prob >= thr then 1 else 0 end) + sum(y)) as f1 from pairs cross join grid37 group by i, thr) x
        order by f1 desc, i limit 1"""),
    "tuned_labels": (["pairs", "grid19"], """select label, arg_max(thr, (f1, -i)) as threshold from (select label, i, thr,
        2.0 * sum(case when prob >= thr then y else 0 end) / (sum(case when prob >= thr then 1 else 0 end) + sum(y)) as f1
        from pairs cross join grid19 group by label, i, thr) x group by label"""),
}


@query("tune_global", ("tuned",), "select round(threshold, 6) as threshold, round(f1, 6) as f1 from tuned", TUNE_SQL)
def tune_global(v: Views) -> DataFrame:
    return M.tune_global_threshold(v.scores(), v.truth()).select(r6("threshold").alias("threshold"), r6("f1").alias("f1"))


@query("tune_labels", ("tuned_labels",), "select label, round(threshold, 6) as threshold from tuned_labels", TUNE_SQL)
def tune_labels(v: Views) -> DataFrame:
    return M.tune_label_thresholds(v.scores(), v.truth(), v.vocab()).withColumn("threshold", r6("threshold"))


EVALUATE_SQL = {
    **PRODUCT_SPLIT,
    **TUNE_SQL,
    "cells_by_split": (["scores", "truth", "split"], """select s.product_sku, x.split, s.label, s.prob, case when t.label is null then 0 else 1 end as y
        from scores s join split x on x.product_sku = s.product_sku and x.split <> 'train'
        left join truth t on t.product_sku = s.product_sku and t.label = s.label"""),
    "pairs": (["cells_by_split"], "select label, prob, y from cells_by_split where split = 'val'"),
    "decided": (["cells_by_split", "tuned", "tuned_labels"], """select c.*, 'global' as mode, c.prob >= (select threshold from tuned) as p from cells_by_split c
        union all select c.*, 'per_label', c.prob >= l.threshold from cells_by_split c join tuned_labels l on l.label = c.label"""),
    "by_label": (["decided"], """select split, mode, label, count(*) filter (p and y = 1) as tp, count(*) filter (p and y = 0) as fp,
        count(*) filter (not p and y = 1) as fn from decided group by all"""),
    "n_split": (["split"], "select split, count(*) as n from split group by 1"),
}


ORACLE_EVALUATE = """select b.split, mode, round(sum(tp) / sum(tp + fp), 6) as micro_precision,
    round(sum(tp) / sum(tp + fn), 6) as micro_recall, round(2 * sum(tp) / sum(2 * tp + fp + fn), 6) as micro_f1,
    round(avg(case when 2 * tp + fp + fn = 0 then 0 else 2.0 * tp / (2 * tp + fp + fn) end), 6) as macro_f1,
    round(sum(tp + fp)::double / max(n), 6) as avg_pred_tags from by_label b join n_split s on s.split = b.split group by 1, 2"""


@query("evaluate", ("by_label", "n_split"), ORACLE_EVALUATE, EVALUATE_SQL)
def evaluate(v: Views) -> DataFrame:
    split = durable(O.stratified_split(v.products(), seed=SEED).select("product_sku", "split").where(F.col("split") != "train"))
    out = tagging.evaluate(v.scores(), v.truth(), split, v.vocab())
    return out.select("split", "mode", *[r6(c).alias(c) for c in out.columns if c not in ("split", "mode")])


CALIBRATED_EVALUATE_SQL = {
    **CALIBRATED_SQL,
    **EVALUATE_SQL,
    "masked_all": (["blended", "allowed"], """select b.product_sku, b.good_type, b.label, b.prob * case
        when a.label is not null or b.good_type not in (select good_type from allowed) then 1 else 0 end as prob
        from blended b left join allowed a on a.good_type = b.good_type and a.label = b.label"""),
    "cells_by_split": (["masked_all", "truth", "split"], EVALUATE_SQL["cells_by_split"][1].replace("from scores s", "from masked_all s")),
}


@query("evaluate_calibrated", ("by_label", "n_split"), ORACLE_EVALUATE, CALIBRATED_EVALUATE_SQL)
def evaluate_calibrated(v: Views) -> DataFrame:
    split = durable(O.stratified_split(v.products(), seed=SEED).select("product_sku", "split").where(F.col("split") != "train"))
    artifacts = AR.Artifacts(
        v.vocab(), _stored(v.thresholds()), _stored(v.allowed()), _stored(_partial_priors(v)), category_prior_weight=1.0
    )
    out = tagging.evaluate_calibrated(v.chunk_scores(), artifacts, v.truth(), split, v.vocab())
    return out.select("split", "mode", *[r6(c).alias(c) for c in out.columns if c not in ("split", "mode")])


WEIGHT_SQL = {"freq": (["truth"], "select label, count(*) as n from truth group by label"),
              "weights": (["freq"], "select label, least(((select sum(n) from freq) - n) / (n + 1e-8::double), 10) as pos_weight from freq")}


@query("pos_weights", ("weights",), "select label, round(pos_weight, 6) as pos_weight from weights", WEIGHT_SQL)
def pos_weights(v: Views) -> DataFrame:
    freq = L.label_frequencies(v.truth().withColumnRenamed("label", "tag"))
    return M.positive_weights(freq, 10.0).withColumn("pos_weight", r6("pos_weight"))


@query("losses", ("scores", "truth", "weights"), """select good_type,
    round(avg(-case when y then ln(p) else ln(1 - p) end), 6) as bce,
    round(avg(-case when y then pos_weight * ln(p) else ln(1 - p) end), 6) as weighted_bce,
    round(avg(-case when y then 0.25 * (1 - p)**2 * ln(p) else 0.75 * p**2 * ln(1 - p) end), 6) as focal,
    round(avg(-case when y then (1 - p) * ln(greatest(p, 1e-8)) else (1 - least(1 - p + 0.05, 1))**4 * ln(greatest(least(1 - p + 0.05, 1), 1e-8)) end), 6) as asl
    from (select s.good_type, least(greatest(s.prob, 1e-6::double), 1 - 1e-6::double) as p, t.label is not null as y, pos_weight from scores s
    join weights w on w.label = s.label left join truth t on t.product_sku = s.product_sku and t.label = s.label) x group by good_type""", WEIGHT_SQL)
def losses(v: Views) -> DataFrame:
    truth = v.truth()
    weights = M.positive_weights(L.label_frequencies(truth.withColumnRenamed("label", "tag")))
    out = M.loss_report(v.scores(), truth, by=["good_type"], pos_weights=weights)
    return out.select("good_type", *[r6(c).alias(c) for c in out.columns if c != "good_type"])


# -- similarity -----------------------------------------------------------------------------------------------

_DOT = "list_dot_product(a.vector::double[], b.vector::double[])"
_COS = f"({_DOT} / sqrt(list_dot_product(a.vector::double[], a.vector::double[]) * list_dot_product(b.vector::double[], b.vector::double[])))"
SIM_SQL = {
    "matched": (["raw_vectors", "canonical"], f"""select raw_id, canonical_id, cosine, r from (
        select a.tag_id as raw_id, b.tag_id as canonical_id, {_COS} as cosine,
        cast(row_number() over (partition by a.tag_id order by {_COS} desc, b.tag_id) as int) as r
        from raw_vectors a cross join canonical b) x where cosine >= 0.2"""),
}


@query("nearest_canonical", ("matched",), """select raw_id, canonical_id, round(cosine, 6) as cosine, r as rank from matched where r <= 2""", SIM_SQL)
def nearest_canonical(v: Views) -> DataFrame:
    return V.map_to_canonical(v.raw_vectors(), v.canonical(), 0.2, 2).withColumn("cosine", r6("cosine"))


@query("canonical_dataset", ("matched",), """select raw_id // 10 as product_sku, string_agg(distinct canonical_id::varchar, '; ' order by canonical_id::varchar)
    as tags from matched where r = 1 group by 1""", SIM_SQL)
def canonical_dataset(v: Views) -> DataFrame:
    raw = v.raw_vectors()
    rows = raw.select(F.floor(F.col("tag_id") / 10).alias("product_sku"), F.col("tag_id").alias("tag"))
    matches = V.map_to_canonical(raw, v.canonical(), 0.2, 1)
    out = P.canonicalise_dataset(rows, matches.withColumn("canonical_id", F.col("canonical_id").cast("string")))
    return out.select("product_sku", T.join_tags("tags").alias("tags"))


@query("similar_pairs", ("vectors",), f"""select id_a, id_b, round(cosine, 6) as cosine from (select a.tag_id as id_a, b.tag_id as id_b, {_COS} as cosine
    from vectors a join vectors b on a.good_type = b.good_type and a.tag_id < b.tag_id) x where cosine > 0.3""")
def similar_pairs(v: Views) -> DataFrame:
    return V.similar_tag_pairs(v.vectors(), 0.3).select("id_a", "id_b", r6("cosine").alias("cosine"))


@query("similar_pairs_lsh", ("family_vectors",), f"""select good_type, id_a, id_b, round(cosine, 6) as cosine from (select a.good_type, a.tag_id as id_a,
    b.tag_id as id_b, {_COS} as cosine from family_vectors a join family_vectors b on a.good_type = b.good_type and a.tag_id < b.tag_id) x
    where cosine > 0.8""")
def similar_pairs_lsh(v: Views) -> DataFrame:
    """By random projections. Pairs of a family are so close that one is missed about once in a million."""
    return N.approximate_tag_pairs(v.family_vectors(), 0.8).withColumn("cosine", r6("cosine"))


@query("similar_pairs_lsh_given")
def similar_pairs_lsh_given(v: Views) -> DataFrame:
    """Over all vectors as given, at a threshold where some pairs are missed: no SQL, the recall is measured in the tests."""
    return N.approximate_tag_pairs(v.vectors(), 0.3).select("id_a", "id_b", r6("cosine").alias("cosine"))


@query("similar_pairs_cosine", ("matched",), "select raw_id, round(max(cosine), 6) as cosine from matched group by raw_id", SIM_SQL)
def similar_pairs_cosine(v: Views) -> DataFrame:
    """The column function on matched pairs: the same similarity as the block kernel."""
    best = V.map_to_canonical(v.raw_vectors(), v.canonical(), 0.2, 1)
    a = v.raw_vectors().select(F.col("tag_id").alias("raw_id"), F.col("vector").alias("_a"))
    b = v.canonical().select(F.col("tag_id").alias("canonical_id"), F.col("vector").alias("_b"))
    return best.join(a, "raw_id").join(b, "canonical_id").select("raw_id", r6(cosine("_a", "_b")).alias("cosine"))


def letter_encoder():
    """Stand-in for an embedding model: text length and two letter counts."""
    return lambda texts: [(len(t), t.count("e"), t.count("o")) for t in texts]


@query("embedded_tags", ("doc_labels",), """select good_type, tag, length(tag)::double as chars, (length(tag) - length(replace(tag,'e','')))::double as e,
    (length(tag) - length(replace(tag,'o','')))::double as o from (select distinct good_type, tag from doc_labels) x""")
def embedded_tags(v: Views) -> DataFrame:
    tags = V.embed_tags(P.build_tag_pools(v.doc_tags()), letter_encoder)
    part = lambda i: F.get("vector", i).cast("double")
    return tags.select("good_type", "tag", part(0).alias("chars"), part(1).alias("e"), part(2).alias("o"))


# Larger groups take the distributed rounds: at any scale at least the one called "wide".
LOCAL_ROWS = 150


@query("tag_clusters", ("families",), "select good_type, tag_id, cluster_id from families")
def tag_clusters(v: Views) -> DataFrame:
    return V.cluster_tags(v.family_vectors(), 0.8, local_rows=LOCAL_ROWS)


@query("tag_clusters_by_mean")
def tag_clusters_by_mean(v: Views) -> DataFrame:
    # All vectors in one group, where means of clusters decide: chains of close pairs reach much further. Iterative, so without SQL.
    return V.cluster_tags(v.vectors(), 0.35, local_rows=LOCAL_ROWS).select("good_type", "tag_id", "cluster_id")


@query("consolidated_pool", ("members",), """select distinct good_type, tag as old_tag, best as new_tag from members where n > 1 and tag <> best
    union all select distinct good_type, '', best from members""", {
    "named": (["families", "family_vectors"], """select f.good_type, cluster_id, concat('t', lpad(f.tag_id::varchar, 9, '0')) as tag, freq
        from families f join family_vectors v on v.tag_id = f.tag_id"""),
    "members": (["named"], """select good_type, tag, count(*) over (partition by good_type, cluster_id) as n,
        first_value(tag) over (partition by good_type, cluster_id order by freq desc, length(tag), tag) as best from named"""),
})
def consolidated_pool(v: Views) -> DataFrame:
    vectors = v.family_vectors().withColumn("tag", F.concat(F.lit("t"), F.lpad(F.col("tag_id").cast("string"), 9, "0")))
    pool = vectors.select("good_type", "tag", "freq")
    tags, rules = tagging.consolidate_pool(pool, vectors, threshold=0.8, local_rows=LOCAL_ROWS)
    return rules.select("good_type", "old_tag", "new_tag").unionByName(
        tags.select("good_type", F.lit("").alias("old_tag"), F.col("tag").alias("new_tag"))
    )


# -- scorers --------------------------------------------------------------------------------------------------


@query("route_category", ("reviews", "routes"), """select comment_id, coalesce(group_key, 'other') as group_key from reviews
    left join routes using (good_type)""")
def route_category(v: Views) -> DataFrame:
    return S.route_category(v.reviews(), v.routes(), "other").select("comment_id", "group_key")


GROUP_LABELS = {"en": ["alpha", "beta", "gamma"], "romance": ["alpha", "delta"], "other": ["omega", "beta", "delta"]}


def digest_scorer(batches):
    """Stand-in for a model: a probability from the digest of text and label, labels by model group.

    Of texts in pieces, which come one behind the other, it keeps only the digest so far.
    """
    import hashlib

    import pandas as pd

    here, digest = None, None

    def ended():
        for label in GROUP_LABELS[here[2]] if here else ():
            whole = digest.copy()
            whole.update(f"|{label}".encode())
            yield *here[:2], 0, label, int(whole.hexdigest()[:4], 16) / 65535.0

    for pdf in batches:
        rows = []
        for sku, kind, group, text in zip(pdf["product_sku"], pdf["good_type"], pdf["group_key"], pdf["text"]):
            if here == (sku, kind, group) and "chunk_id" in pdf:
                digest.update(b" ")
            else:
                rows += ended()
                here, digest = (sku, kind, group), hashlib.md5()
            digest.update(text.encode())
        yield pd.DataFrame(rows, columns=["product_sku", "good_type", "chunk_id", "label", "prob"])
    yield pd.DataFrame(list(ended()), columns=["product_sku", "good_type", "chunk_id", "label", "prob"])


# Characters of a text that one row holds, if no single review is longer.
PIECE_CHARS = 20000


def _text_pieces(v: Views) -> DataFrame:
    """(product_sku, good_type, chunk_id, text): the product texts in pieces."""
    reviews = v.reviews()
    kinds = reviews.where(F.col("product_sku").isNotNull()).groupBy("product_sku").agg(first_by("good_type", F.struct("comment_id"), False).alias("good_type"))
    pieces = A.product_text_chunks(reviews, PIECE_CHARS).join(kinds, "product_sku")
    return durable(pieces.select("product_sku", "good_type", "chunk_id", "text"))


_GROUP_ROWS = ",".join(f"('{g}','{lab}')" for g, labs in GROUP_LABELS.items() for lab in labs)
GROUP_SQL = {
    **PRODUCT_SQL,
    "group_scores": (["product_texts", "routes"], f"""select product_sku, good_type, text, label,
        ('0x'||substr(md5(concat(text,'|',label)),1,4))::int / 65535.0::double as prob from (
            select p.product_sku, p.good_type, p.text, coalesce(group_key, 'other') as group_key from product_texts p
            left join routes on routes.good_type = p.good_type) x
        join (values {_GROUP_ROWS}) g(grp, label) on grp = group_key"""),
    "group_choice": (["group_scores"], """select product_sku, good_type, label, prob, rank from (
        select *, cast(row_number() over (partition by product_sku order by prob >= 0.5 desc, prob desc, label) as int) as rank
        from group_scores) z where rank <= 8 and (prob >= 0.5 or rank = 1)"""),
    # The client ranks a third of the products anew, by the digest of the text it was given.
    "asked": (["group_scores"], """select product_sku, good_type, label, text,
        row_number() over (partition by product_sku order by prob desc, label) as place from group_scores"""),
    "reranked": (["asked"], """select product_sku, good_type, label, round(1.0::double / place, 6) as prob, place::int as rank from asked
        where place <= 2 and md5(substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 2000)) < '5'"""),
}


@query("predict_by_group", ("group_choice",), "select product_sku, good_type, label, round(prob, 6) as prob, rank from group_choice", GROUP_SQL)
def predict_by_group(v: Views) -> DataFrame:
    return S.predict_by_group(_text_pieces(v), v.routes(), digest_scorer, 0.5, 8, "other", piece="chunk_id").withColumn("prob", r6("prob"))


CLIENT_TEMPLATE = "{text}\x01{candidates}\x01{max_return}"


def digest_client():
    """Stand-in for a reranking service: keeps the first two candidates of texts whose digest is small, fails on some others."""
    import hashlib
    import json
    import re

    def send(prompt: str) -> str:
        text, candidates, _ = prompt.split("\x01")
        digest = hashlib.md5(text.encode()).hexdigest()
        if digest >= "a":
            raise RuntimeError("no answer")
        if digest >= "5":
            return "no JSON"
        names = re.findall(r"(?m)^\d+\. (.*) \(model_prob=", candidates)[:2]
        return json.dumps({"tags": [{"tag": t, "score": round(1 / (i + 1), 6)} for i, t in enumerate(names)]})

    return send


@query("rerank_with_client", ("reranked", "group_choice"), """select product_sku, good_type, label, prob, rank from reranked
    union all select product_sku, good_type, label, round(prob, 6), rank from group_choice
    where product_sku not in (select product_sku from reranked)""", GROUP_SQL)
def rerank_with_client(v: Views) -> DataFrame:
    # Every product stands twice in the table of texts; it is asked and answered once.
    pieces = _text_pieces(v)
    texts = X.prompt_text(pieces, 2000)
    out = S.predict_by_group(
        pieces.unionAll(pieces), v.routes(), digest_scorer, 0.5, 8, "other", reranker=digest_client, template=CLIENT_TEMPLATE, tasks=8, threads=2,
        piece="chunk_id", texts=texts.unionAll(texts),
    )
    return out.withColumn("prob", r6("prob"))


WINDOW_SQL = {
    "doc_tokens": ([], """select doc_id as product_sku, lang as good_type,
        list_filter(string_split(lower(text),' '), lambda t: t <> '') as tokens from documents"""),
    "doc_windows": (["doc_tokens"], """select product_sku, good_type, c.chunk_id::int as chunk_id,
        tokens[c.chunk_id * 126 + 1 : c.chunk_id * 126 + 254] as win from doc_tokens,
        lateral (select unnest(range(0, 1 + greatest(0, ceil((len(tokens) - 254) / 126.0))::int)) as chunk_id) c"""),
}


def _doc_windows(v: Views) -> DataFrame:
    docs = v.table("documents").select(
        F.col("doc_id").alias("product_sku"), F.col("lang").alias("good_type"), S.blank_tokens("text").alias("tokens")
    )
    return S.token_windows(docs, "tokens")


@query("token_windows", ("doc_windows",), """select product_sku, chunk_id, len(win)::int as n_tokens,
    md5(array_to_string(win, ' ')) as digest from doc_windows""", WINDOW_SQL)
def token_windows(v: Views) -> DataFrame:
    return _doc_windows(v).select(
        "product_sku", "chunk_id", F.size("window").alias("n_tokens"), F.md5(F.array_join("window", " ")).alias("digest")
    )


SCORER_SQL = {
    **WINDOW_SQL,
    "judged": ([], "select doc_id as product_sku, lang as good_type from documents join labels using (doc_id)"),
    "marks": ([], """select doc_id as product_sku, 'quality' as label from labels where quality = 1
        union all select doc_id, 'toxic' from labels where toxic = 1"""),
    "tok": (["doc_tokens", "judged"], """select product_sku, good_type, unnest(list_distinct(tokens)) as token from doc_tokens
        where product_sku in (select product_sku from judged)"""),
    "sizes": (["judged"], "select good_type, count(*) as n from judged group by 1"),
    "pos_sizes": (["judged", "marks"], "select good_type, label, count(*) as n_pos from judged join marks using (product_sku) group by 1, 2"),
    "df_all": (["tok"], "select good_type, token, count(*) as df from tok group by 1, 2"),
    "df_pos": (["tok", "marks"], "select good_type, token, label, count(*) as dp from tok join marks using (product_sku) group by 1, 2, 3"),
    "w": (["df_all", "df_pos", "sizes", "pos_sizes"], """select a.good_type, a.token, p.label,
        ln((coalesce(d.dp,0) + 1.0::double) / (p.n_pos + 2)) - ln((a.df - coalesce(d.dp,0) + 1.0::double) / (s.n - p.n_pos + 2)) as w
        from df_all a join sizes s on s.good_type = a.good_type join pos_sizes p on p.good_type = a.good_type
        left join df_pos d on d.good_type = a.good_type and d.token = a.token and d.label = p.label"""),
    "cells_scored": (["doc_windows", "w", "sizes", "pos_sizes"], """select product_sku, good_type, chunk_id, label, sum(w) as x from (
        select c.product_sku, c.good_type, c.chunk_id, w.label, w.w from (
            select product_sku, good_type, chunk_id, unnest(list_distinct(win)) as token from doc_windows) c
        join w on w.good_type = c.good_type and w.token = c.token
        union all select d.product_sku, d.good_type, d.chunk_id, p.label, ln((p.n_pos + 1.0::double) / (s.n - p.n_pos + 1))
        from doc_windows d join pos_sizes p on p.good_type = d.good_type join sizes s on s.good_type = d.good_type) q group by all"""),
}


@query("token_scorer", ("cells_scored",), """select product_sku, good_type, label,
    round(max(case when x >= 0 then 1 / (1 + exp(-x)) else exp(x) / (1 + exp(x)) end), 6) as prob from cells_scored group by all""", SCORER_SQL)
def token_scorer(v: Views) -> DataFrame:
    judged = v.table("labels").withColumnRenamed("doc_id", "product_sku")
    marks = judged.select("product_sku", F.explode(F.filter(F.array(
        F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())).alias("label"))
    docs = v.table("documents").select(F.col("doc_id").alias("product_sku"), F.col("lang").alias("good_type"), "text")
    known = docs.join(judged, "product_sku", "left_semi")
    products = known.select("product_sku", "good_type")
    weights = _stored(S.fit_scorer(known.withColumn("tokens", S.blank_tokens("text")), marks, products))
    windows = _doc_windows(v).withColumnRenamed("window", "tokens")
    chunks = S.score_tokens(windows, weights, S.label_bias(marks, products))
    return C.max_pool_scores(chunks).withColumn("prob", r6("prob"))


# -- storage --------------------------------------------------------------------------------------------------


def _fresh(v: Views, name: str) -> str:
    import uuid

    return f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"


@query("reviews_csv_roundtrip", ("reviews",), "select comment_id, product_sku, comment_text, name, good_type, good_subtype from reviews")
def reviews_csv_roundtrip(v: Views) -> DataFrame:
    path = _fresh(v, "reviews-csv")
    TB.write_table(v.reviews(), path, "csv", sep=";")
    return TB.read_reviews(v.spark, path, sep=";")


@query("reviews_csv_mixed", ("reviews",), """select comment_id, product_sku, comment_text, name, good_type,
    case when good_type = 'en' then good_subtype end as good_subtype from reviews""")
def reviews_csv_mixed(v: Views) -> DataFrame:
    # Files of different column order, one of them without an optional column and with one more.
    path = _fresh(v, "reviews-mixed")
    rows = v.reviews()
    english = F.col("good_type") == "en"
    TB.write_table(rows.where(english), f"{path}/1", "csv")
    other = rows.where(~english).select(F.lit("x").alias("unknown"), "good_type", "comment_text", "name", "comment_id", "product_sku")
    TB.write_table(other, f"{path}/2", "csv")
    return TB.read_reviews(v.spark, f"{path}/*").select("comment_id", "product_sku", "comment_text", *A.ATTRS)


@query("reviews_csv_blocks", ("reviews",), """select comment_id, product_sku, replace(replace(comment_text, '.', '".'), 'e', chr(10)) as comment_text,
    name, good_type, good_subtype from reviews""")
def reviews_csv_blocks(v: Views) -> DataFrame:
    # Cells full of line breaks and quotes, in files that are read in blocks of 64 KiB, so that blocks begin anywhere in cells.
    path = _fresh(v, "reviews-blocks")
    text = F.replace(F.replace("comment_text", F.lit("."), F.lit('".')), F.lit("e"), F.lit("\n"))
    TB.write_table(v.reviews().withColumn("comment_text", text), path, "csv", sep=";")
    return TB.read_reviews(v.spark, path, sep=";", block_bytes=1 << 16)


@query("pool_files", ("tag_cells",), "select distinct good_type, lower(tag) as tag from tag_cells")
def pool_files(v: Views) -> DataFrame:
    path = _fresh(v, "pool-csv")
    TB.write_table(P.pool_rows(P.build_tag_pools(v.tagged())), path, "csv")
    return TB.read_tag_pool(v.spark, path)


@query("training_pairs", ("raw_lists", "products"), """select concat('order ', product_sku) as text,
    '["' || replace(tags, '; ', '","') || '"]' as tags from raw_lists""", REWRITE)
def training_pairs(v: Views) -> DataFrame:
    path = _fresh(v, "pairs-csv")
    lists = A.product_tags(v.tagged(), order_by=ORDER)
    TB.write_training_pairs(lists.select(F.concat(F.lit("order "), F.col("product_sku").cast("string")).alias("text"), "tags"), path)
    return TB.read_csv(v.spark, path, "text string, tags string", required=("text", "tags"))


@query("artifacts_roundtrip", ("priors", "thresholds", "allowed"), """select 'prior' as kind, good_type, label, round(prior_logit, 6) as value from priors
    union all select 'threshold', null, label, round(threshold, 6) from thresholds
    union all select 'threshold', null, null, 0.35::double
    union all select 'allowed', good_type, label, 1.0::double from allowed
    union all select 'top_k', null, null, 8.0::double""", STATS_SQL)
def artifacts_roundtrip(v: Views) -> DataFrame:
    path = _fresh(v, "artifacts")
    overall = v.spark.range(1).select(F.lit(0.35).alias("threshold"))
    AR.save_artifacts(
        AR.Artifacts(v.vocab(), AR.threshold_table(v.thresholds(), overall), v.allowed(), _priors(v), category_prior_weight=1.0), path
    )
    a = AR.load_artifacts(v.spark, path)
    none = F.lit(None).cast("string")
    rows = [
        a.priors.select(F.lit("prior").alias("kind"), "good_type", "label", r6("prior_logit").alias("value")),
        a.thresholds.select(F.lit("threshold").alias("kind"), none.alias("good_type"), "label", r6("threshold").alias("value")),
        a.allowed.select(F.lit("allowed").alias("kind"), "good_type", "label", F.lit(1.0).alias("value")),
        v.spark.range(1).select(F.lit("top_k").alias("kind"), none.alias("good_type"), none.alias("label"), F.lit(float(a.top_k)).alias("value")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
