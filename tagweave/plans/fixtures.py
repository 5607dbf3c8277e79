"""Review, tag and score tables derived from the supplied star-schema, text and vector tables.

The only module that knows those tables. ``Views`` builds them in Spark, ``SQL`` holds the same definitions
for DuckDB; ``with_views`` puts the needed ones in front of a query.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 42
UNLISTED_TYPE = "4-NOT SPECIFIED"
RULES = [
    ("small", "tiny", 0), ("hot", "warm", 1), ("warm", "cold", 2), ("old", "", 3),
    ("new", "fresh", 4), ("new", "old", 5), ("red", "blue", 6),
]
ROUTES = [("en", "en"), ("fr", "romance"), ("es", "romance")]


def hex4(key: Column) -> Column:
    """First four hex digits of the digest as a number in 0..65535."""
    return F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int")


# Bytes of files up to which a table is dealt over all cores; a shuffle of so little costs next to nothing.
SPREAD_BYTES = 256 << 20
# Order lines times labels that one task expands to scores. Spark sizes a shuffle's tasks by the narrow rows in it, not by what they become.
CELLS_PER_TASK = 1 << 21
# Order lines, or orders, that one task sorts and joins. A small file of them may hold rows that are large as a broadcast table in every task.
LINES_PER_TASK = 1 << 17


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a small table: a small file has one row group, which would keep all work up to the next shuffle on
    one core. Tables of more bytes have parts enough and are left as they are."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if int(str(size)) <= SPREAD_BYTES else df


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if name in ("documents", "lineitem") else df

    def reviews(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("comment_id"),
            F.concat("source", F.lit("-"), "lang").alias("product_sku"),
            F.col("text").alias("comment_text"),
            F.col("source").alias("name"),
            F.col("lang").alias("good_type"),
            F.col("source").alias("good_subtype"),
        )

    def conv_reviews(self) -> DataFrame:
        return self.table("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("comment_id"),
            F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("product_sku"),
            F.col("text").alias("comment_text"),
            F.col("role").alias("name"),
            F.col("role").alias("good_type"),
            F.col("role").alias("good_subtype"),
        )

    def cells(self) -> DataFrame:
        name, kind = F.col("p_name"), F.col("p_partkey") % 5
        cell = (
            F.when(kind == 0, F.concat(F.lit('["'), F.replace(name, F.lit(" "), F.lit('", "')), F.lit('"]')))
            .when(kind == 1, F.concat(F.lit("['"), F.replace(name, F.lit(" "), F.lit("', '")), F.lit("']")))
            .when(kind == 2, name)
            .when(kind == 4, F.lit(""))
        )
        return self.table("part").select(F.col("p_partkey").alias("id"), cell.alias("cell"))

    @functools.cached_property
    def line_tasks(self) -> int:
        """Number of tasks that hold about ``LINES_PER_TASK`` lines and orders each; it grows with the tables."""
        rows = max(self.spark.read.parquet(f"{self.folder}/{name}.parquet").count() for name in ("lineitem", "orders"))
        return max(self.spark.sparkContext.defaultParallelism, -(-rows // LINES_PER_TASK))

    def _lines(self, tasks: int) -> DataFrame:
        """Lines with their part's name and their order's priority, by order in ``tasks`` tasks."""
        li = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        part = self.table("part").select("p_partkey", "p_name")
        lines = li.join(part, li.l_partkey == part.p_partkey).repartition(tasks, "l_orderkey")
        orders = self.table("orders").select("o_orderkey", "o_orderpriority").repartition(tasks, "o_orderkey")
        return lines.join(orders.hint("shuffle_hash"), lines.l_orderkey == orders.o_orderkey)

    def tagged(self) -> DataFrame:
        loose = F.replace("p_name", F.lit(" "), F.lit(" ;"))
        upper = F.replace(F.upper("p_name"), F.lit(" "), F.lit("; "))
        return self._lines(self.line_tasks).select(
            F.col("l_orderkey").alias("product_sku"),
            F.col("o_orderpriority").alias("good_type"),
            F.col("l_linenumber").alias("ord1"),
            F.col("l_partkey").alias("ord2"),
            F.when(F.col("l_linenumber") % 2 == 0, upper).otherwise(loose).alias("tags"),
        )

    @staticmethod
    def _words() -> Column:
        words = F.split("p_name", " ")
        return F.array(F.get(words, 0), F.get(words, 1))

    def vocab(self) -> DataFrame:
        from tagweave.operators.labels import number_labels

        labels = self.table("part").select(F.explode(self._words()).alias("label")).distinct()
        return number_labels(labels)

    @functools.cached_property
    def score_tasks(self) -> int:
        """Number of tasks that hold at most about ``CELLS_PER_TASK`` cells of lines and labels each; it grows with the tables."""
        lines = self.spark.read.parquet(f"{self.folder}/lineitem.parquet").count()
        labels = self.table("part").select(F.explode(self._words()).alias("label")).distinct().count()
        return max(self.line_tasks, -(-lines * labels // CELLS_PER_TASK))

    def labelled_products(self) -> DataFrame:
        """(product_sku, good_type, _labels): label set per product, at most two labels per line.

        Lies by product in as many tasks as its scores need; they and the truth then meet without another shuffle.
        """
        return self._lines(self.score_tasks).select(
            F.col("l_orderkey").alias("product_sku"), F.col("o_orderpriority").alias("good_type"),
            F.explode(self._words()).alias("label"),
        ).groupBy("product_sku", "good_type").agg(F.collect_set("label").alias("_labels"))

    def truth(self) -> DataFrame:
        return self.labelled_products().select("product_sku", "good_type", F.explode("_labels").alias("label"))

    def products(self) -> DataFrame:
        lines = self.spark.read.parquet(f"{self.folder}/lineitem.parquet").select(F.col("l_orderkey").alias("product_sku"))
        lines = lines.repartition(self.line_tasks, "product_sku").hint("shuffle_hash")
        orders = self.table("orders").select(F.col("o_orderkey").alias("product_sku"), F.col("o_orderpriority").alias("good_type"))
        return orders.join(lines, "product_sku", "left_semi")

    def types(self) -> DataFrame:
        return self.products().select("good_type").distinct()

    def allowed(self) -> DataFrame:
        from tagweave.operators.priors import vocab_array

        rows = self.types().withColumn("_v", vocab_array(self.vocab())).select("good_type", F.explode("_v").alias("label"))
        listed = F.md5(F.concat("good_type", F.lit("|"), "label")) < "c"
        return rows.where(listed & (F.col("good_type") != UNLISTED_TYPE))

    def mapping(self) -> DataFrame:
        rules = F.array(*[
            F.struct(F.lit(a).alias("old_tag"), F.lit(b).alias("new_tag"), F.lit(i).alias("ord")) for a, b, i in RULES
        ])
        return self.types().select("good_type", F.inline(rules))

    def chunk_scores(self) -> DataFrame:
        from tagweave.operators.priors import vocab_array

        cells = (
            self.labelled_products()
            .withColumn("_v", vocab_array(self.vocab()))
            .select("product_sku", "good_type", "_labels", F.explode("_v").alias("label"))
            .select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("chunk_id"))
        )
        key = F.concat_ws("|", F.col("product_sku").cast("string"), "label", F.col("chunk_id").cast("string"))
        bonus = F.when(F.array_contains("_labels", F.col("label")), 0.4).otherwise(0.0)
        prob = hex4(key).cast("double") / 65535 * F.lit(0.6) + bonus
        return cells.select("product_sku", "good_type", "label", "chunk_id", prob.alias("prob"))

    def scores(self) -> DataFrame:
        from tagweave.operators.selection import max_pool_scores

        return max_pool_scores(self.chunk_scores())

    def thresholds(self) -> DataFrame:
        return self.vocab().select("label", (F.lit(0.35) + F.lit(0.02) * F.col("label_id")).alias("threshold"))

    def routes(self) -> DataFrame:
        return self.spark.createDataFrame(ROUTES, "good_type string, group_key string")

    def doc_tags(self) -> DataFrame:
        """Every blank-separated word of a document is a tag; newlines inside words stay."""
        return self.table("documents").select(
            F.col("doc_id").alias("product_sku"), F.col("lang").alias("good_type"),
            F.col("doc_id").alias("comment_id"),
            F.replace(F.lower("text"), F.lit(" "), F.lit("; ")).alias("tags"),
        )

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.lit("all").alias("good_type"), F.col("vec_id").alias("tag_id"),
            F.col("embedding").alias("vector"), F.col("label").alias("family"),
        )

    def family_vectors(self) -> DataFrame:
        """Families of four: a fifth of a vector's own embedding on top of the one of its family's first vector.

        Inside a family all cosines are far above 0.8, between families far below.
        """
        own = self.table("embeddings").select(F.col("vec_id").alias("tag_id"), "embedding", (F.col("vec_id") - F.col("vec_id") % 4).alias("_head"))
        heads = own.where("tag_id = _head").select("_head", F.col("embedding").alias("_first"))
        kinds = self.table("embeddings").select(F.col("vec_id").alias("_head"), F.col("label").alias("_kind"))
        rows = own.join(heads, "_head").join(kinds, "_head")
        kind = F.when(F.col("_kind") < 5, "wide").otherwise(F.concat(F.lit("g"), F.col("_kind").cast("string")))
        vector = F.zip_with("_first", "embedding", lambda a, b: a.cast("double") + b.cast("double") * 0.2)
        return rows.select(kind.alias("good_type"), "tag_id", vector.alias("vector"), (F.col("tag_id") % 7).alias("freq"))

    def canonical(self) -> DataFrame:
        v = self.vectors()
        heads = v.groupBy("family").agg(F.min("tag_id").alias("tag_id")).select("tag_id")
        return v.join(heads, "tag_id", "left_semi")

    def raw_vectors(self) -> DataFrame:
        v = self.vectors()
        heads = v.groupBy("family").agg(F.min("tag_id").alias("tag_id")).select("tag_id")
        return v.join(heads, "tag_id", "left_anti")


_HEX4 = "(('0x'||substr(md5({0}),1,4))::int)"
_LINES = "lineitem join orders on l_orderkey=o_orderkey join part on l_partkey=p_partkey"

SQL: dict[str, tuple[list[str], str]] = {
    "reviews": ([], """select doc_id as comment_id, concat(source,'-',lang) as product_sku, text as comment_text,
        source as name, lang as good_type, source as good_subtype from documents"""),
    "conv_reviews": ([], """select conv_id*1000+turn as comment_id, concat('C',cast(conv_id as varchar)) as product_sku,
        text as comment_text, role as name, role as good_type, role as good_subtype from conversations"""),
    "cells": ([], """select p_partkey as id, p_name, case p_partkey % 5
        when 0 then concat('["', replace(p_name,' ','", "'), '"]')
        when 1 then concat('[''', replace(p_name,' ',''', '''), ''']')
        when 2 then p_name when 3 then null else '' end as cell from part"""),
    "tagged": ([], f"""select l_orderkey as product_sku, o_orderpriority as good_type, l_linenumber as ord1, l_partkey as ord2,
        case when l_linenumber % 2 = 0 then replace(upper(p_name),' ','; ') else replace(p_name,' ',' ;') end as tags
        from {_LINES}"""),
    "tag_cells": (["tagged"], """select product_sku, good_type, ord1, ord2, u.i,
        trim(string_split(tags,';')[u.i]) as tag
        from tagged, lateral (select unnest(range(1, len(string_split(tags,';'))+1)) as i) u
        where trim(string_split(tags,';')[u.i]) <> ''"""),
    "vocab": ([], """select label, cast(row_number() over (order by label) - 1 as int) as label_id
        from (select distinct split_part(p_name,' ',1) as label from part
              union select distinct split_part(p_name,' ',2) from part) x"""),
    "truth": (["vocab"], f"""select distinct l_orderkey as product_sku, o_orderpriority as good_type, label
        from {_LINES} join vocab on label=split_part(p_name,' ',1) or label=split_part(p_name,' ',2)"""),
    "products": (["truth"], "select distinct product_sku, good_type from truth"),
    "allowed": (["truth", "vocab"], f"""select good_type, label from (select distinct good_type from truth) t cross join vocab
        where md5(concat(good_type,'|',label)) < 'c' and good_type <> '{UNLISTED_TYPE}'"""),
    "mapping": (["truth"], """select good_type, old_tag, new_tag, ord from (select distinct good_type from truth) t
        cross join (values """ + ",".join(f"('{a}','{b}',{i})" for a, b, i in RULES) + ") as m(old_tag,new_tag,ord)"),
    "chunk_scores": (["products", "vocab", "truth"], f"""select p.product_sku, p.good_type, v.label, c.chunk_id,
        cast({_HEX4.format("concat_ws('|', p.product_sku, v.label, c.chunk_id)")} as double)/65535*cast(0.6 as double)
        + case when t.label is null then cast(0 as double) else cast(0.4 as double) end as prob
        from products p cross join vocab v cross join (values (0),(1),(2)) as c(chunk_id)
        left join truth t on t.product_sku=p.product_sku and t.label=v.label"""),
    "scores": (["chunk_scores"], """select product_sku, good_type, label, max(prob) as prob
        from chunk_scores group by all"""),
    "thresholds": (["vocab"], "select label, cast(0.35 as double) + cast(0.02 as double)*label_id as threshold from vocab"),
    "routes": ([], "select * from (values " + ",".join(f"('{a}','{b}')" for a, b in ROUTES) + ") as r(good_type, group_key)"),
    "doc_tags": ([], """select doc_id as product_sku, lang as good_type, doc_id as comment_id,
        replace(lower(text),' ','; ') as tags from documents"""),
    "doc_labels": (["doc_tags"], """select distinct product_sku, good_type, tag from (
        select product_sku, good_type, regexp_replace(unnest(string_split(tags,';')),'^\\s+|\\s+$','','g') as tag from doc_tags) x
        where tag <> ''"""),
    "vectors": ([], "select 'all' as good_type, vec_id as tag_id, embedding as vector, label as family from embeddings"),
    "family_vectors": ([], """select case when h.label < 5 then 'wide' else concat('g', h.label) end as good_type, e.vec_id as tag_id,
        list_transform(list_zip(h.embedding, e.embedding), lambda p: p[1]::double + p[2]::double * 0.2) as vector, e.vec_id % 7 as freq
        from embeddings e join embeddings h on h.vec_id = e.vec_id - e.vec_id % 4"""),
    "close_pairs": (["family_vectors"], """select a.good_type, a.tag_id as a, b.tag_id as b from family_vectors a
        join family_vectors b on a.good_type = b.good_type and list_cosine_similarity(a.vector, b.vector) > 0.8"""),
    # Families lie so far apart that what close pairs link is what average linkage merges.
    "linked": (["close_pairs"], """select good_type, a, a as b from close_pairs
        union select l.good_type, l.a, p.b from linked l join close_pairs p on p.good_type = l.good_type and p.a = l.b"""),
    "families": (["linked"], "select good_type, a as tag_id, min(b) as cluster_id from linked group by all"),
    "canonical": (["vectors"], "select * from vectors where tag_id in (select min(tag_id) from vectors group by family)"),
    "raw_vectors": (["vectors"], "select * from vectors where tag_id not in (select min(tag_id) from vectors group by family)"),
}


def with_views(names: list[str], body: str, extra: dict[str, tuple[list[str], str]] | None = None) -> str:
    """``body`` behind the CTEs it needs, each once and after the ones it depends on."""
    defs = {**SQL, **(extra or {})}
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in defs[name][0]:
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{n} as materialized ({defs[n][1]})" for n in ordered)
    return f"with recursive {ctes}\n{body}" if ctes else body
