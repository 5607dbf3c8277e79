from collections import Counter

from pyspark.sql import functions as F
from tagweave.functions import text as T
from tagweave.operators import layout, pools, replies, scoring
from tagweave.operators import products as A
from tagweave.operators import sampling as O


def skewed(spark):
    """One product with most of the rows, a few small ones, a null key; comments and tags by position."""
    rows = [(i, "hot", f"c{i}" if i % 7 else " ", None if i < 3 else "n", "t", "s", f"x{i % 11}; Y{i % 5}") for i in range(300)]
    rows += [(1000 + i, f"p{i % 4}", f"d{i}", "m", "t", "s", "a; b") for i in range(20)]
    rows += [(5000, None, "lost", "m", "t", "s", "z")]
    return spark.createDataFrame(rows, "comment_id long, product_sku string, comment_text string, name string, good_type string, good_subtype string, tags string").repartition(5)


def test_a_product_is_one_row_whatever_its_size(spark):
    df = skewed(spark)
    rows = {r["product_sku"]: r for r in A.aggregate_products(df).collect()}
    assert set(rows) == {"hot", "p0", "p1", "p2", "p3"} and rows["hot"]["name"] is None and rows["p0"]["name"] == "m"
    assert rows["hot"]["text"].endswith("| " + " ".join(f"c{i}" for i in range(300) if i % 7))
    grouped = {r["product_sku"]: r for r in A.group_reviews(df).collect()}
    assert grouped["hot"]["comment_id"] == list(range(300)) and grouped["hot"]["n_reviews"] == 300 and grouped["hot"]["name"] == "n"
    assert A.min_reviews(A.group_reviews(df), 6).count() == 1
    one = A.concat_reviews(df).where("product_sku = 'hot'").first()
    assert one["comment_text"].split("\n") == [f"c{i}" if i % 7 else " " for i in range(300)] and one["n_comments"] == 300


def test_blank_comments_keep_the_section_open(spark):
    rows = [(i, "p", " " if i < 5 else f"c{i}", "n", "t", "s") for i in range(9)] + [(i, "q", " ", "n", "t", "s") for i in range(9)]
    df = spark.createDataFrame(rows, "comment_id long, product_sku string, comment_text string, name string, good_type string, good_subtype string")
    assert {r["product_sku"]: r["text"] for r in A.aggregate_products(df).collect()} == {"p": "n | t | s | c5 c6 c7 c8", "q": "n | t | s | "}


def test_chunks_of_long_rows_equal_those_of_one_array(spark):
    df = skewed(spark).withColumn("comment_text", F.when(F.col("comment_id") % 9 == 4, None).otherwise(F.col("comment_text")))
    twice = df.unionAll(df.where("comment_id % 5 = 0"))
    for rows in (df, twice):
        for size in (1, 7, 40, 10_000):
            arrays = A.group_reviews(rows).select("product_sku", F.posexplode(T.chunk_reviews("comment_text", size)).alias("chunk_id", "reviews"))
            want = {(r["product_sku"], r["chunk_id"]): r["reviews"] for r in arrays.collect()}
            found = A.review_chunks(rows, size).collect()
            assert {(r["product_sku"], r["chunk_id"]): r["reviews"] for r in found} == want
            last = {}
            for sku, chunk in want:
                last[sku] = max(last.get(sku, 0), chunk + 1)
            assert all(r["n_chunks"] == last[r["product_sku"]] for r in found)


def test_text_in_chunks_is_the_product_text(spark):
    df = skewed(spark).withColumn("comment_text", F.when(F.col("comment_id") % 9 == 4, '["l1", " ", "l2"]').otherwise(F.col("comment_text")))
    odd = [(1, "blank", " ", "n", "t", "s", None), (2, "none", None, "n", " ", "s", None), (3, "list", '["a b", "c"]', None, None, None, None)]
    df = df.unionAll(spark.createDataFrame(odd, df.schema))
    df = df.unionAll(df.where("comment_id % 5 = 0"))
    want = {r["product_sku"]: r["text"] for r in A.aggregate_products(df).collect()}
    for size in (1, 40, 10_000):
        found = {}
        for r in sorted(A.product_text_chunks(df, size).collect(), key=lambda r: (r["product_sku"], r["chunk_id"])):
            found.setdefault(r["product_sku"], []).append(r)
        assert {k: " ".join(r["text"] for r in rows) for k, rows in found.items()} == want
        assert all([r["chunk_id"] for r in rows] == list(range(rows[0]["n_chunks"])) for rows in found.values())
        assert len(found["hot"]) == 1 if size == 10_000 else max(len(r["text"]) for r in found["hot"][1:]) <= 2 * size + 4


def test_union_lists_keep_the_first_spelling_in_order(spark):
    df = spark.createDataFrame([(2, "p", "b; A"), (1, "p", "a; B;c"), (3, "p", ""), (1, "q", None)], "comment_id long, product_sku string, tags string")
    plain = {r[0]: r[1] for r in A.union_lists(df, T.parse_tags("tags")).collect()}
    folded = {r[0]: r[1] for r in A.union_lists(df, T.parse_tags("tags"), ignore_case=True).collect()}
    assert plain == {"p": ["a", "B", "c", "b", "A"], "q": []} and folded == {"p": ["a", "B", "c"], "q": []}


def test_first_ignores_or_keeps_nulls(spark):
    df = skewed(spark).where("product_sku = 'hot'")
    assert A.aggregate_products(df).first()["name"] is None
    assert A.aggregate_products(df, ignore_nulls=True).first()["name"] == "n"
    assert A.first_rows(df).first()["name"] == "n"


def test_missing_attributes_default_to_blank(spark):
    df = spark.createDataFrame([(1, "p", '["a","b"]')], "comment_id long, product_sku string, comment_text string")
    row = A.product_explorer(df).first()
    assert row["text"] == "a b" and row["comments"] == ["a", "b"] and row["option_label"] == "p — Без названия"


def test_busy_rows(spark):
    df = skewed(spark)
    assert A.rows_of_busy_products(df, 6).count() == 300


def test_windows_over_parts(spark):
    whole = [f"w{i}" for i in range(40)]
    cuts = [(0, 0, 13), (1, 13, 14), (2, 14, 14), (3, 14, 31), (4, 31, 40)]
    parted = spark.createDataFrame([("p", p, whole[a:b]) for p, a, b in cuts] + [("e", 0, [])], "product_sku string, part int, tokens array<string>")
    single = spark.createDataFrame([("p", whole), ("e", [])], "product_sku string, tokens array<string>")
    a = scoring.token_windows_of_parts(parted, "tokens", size=12, overlap=4, special=2)
    b = scoring.token_windows(single, "tokens", size=12, overlap=4, special=2)
    rows = lambda df: sorted((r["product_sku"], r["chunk_id"], tuple(r["window"])) for r in df.collect())
    assert rows(a) == rows(b)


def test_window_counts(spark):
    sizes = [0, 1, 254, 255, 380, 381]
    df = spark.createDataFrame([(n, ["x"] * n) for n in sizes], "n int, tokens array<string>")
    got = Counter(r["n"] for r in scoring.token_windows(df, "tokens").collect())
    assert got == {0: 1, 1: 1, 254: 1, 255: 2, 380: 2, 381: 3}


def test_hash_rank_is_exact(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b"))
    ranked = layout.hash_rank(df, "id", ["g"]).collect()
    for g, n in (("a", 1000), ("b", 1000), (None, 1000)):
        assert sorted(r["hash_rank"] for r in ranked if r["g"] == g) == list(range(1, n + 1))


def test_sampling(spark):
    df = spark.range(1000).select(F.col("id").alias("comment_id"), F.when(F.col("id") < 900, "big").when(F.col("id") < 990, "small").alias("good_type"))
    got = Counter(r["good_type"] for r in O.sample_per_type(df, 100).collect())
    assert got == {"big": 100, "small": 90}
    again = {r["comment_id"] for r in O.sample_per_type(df.repartition(7), 100).collect()}
    assert again == {r["comment_id"] for r in O.sample_per_type(df, 100).collect()}
    assert O.sample_rows(df, 10, "comment_id").count() == 10


def test_stratified_split_rules(spark):
    rows = [(i, "a") for i in range(50)] + [(100 + i, "b") for i in range(30)] + [(200, "rare"), (201, "rare"), (300, None)]
    df = spark.createDataFrame(rows, "product_sku long, good_type string")
    out = O.stratified_split(df).collect()
    assert len(out) == 83 and {r["split"] for r in out if r["good_type"] in ("rare", None)} == {"train"}
    assert Counter((r["good_type"], r["split"]) for r in out if r["split"] != "train") == {
        ("a", "test"): 5, ("b", "test"): 3, ("a", "val"): 5, ("b", "val"): 3,
    }
    plain = O.stratified_split(df.where("good_type = 'a'")).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in plain} == {"train": 40, "val": 5, "test": 5}


def test_fixed_split_and_downsample(spark):
    df = spark.createDataFrame([(i, "a" if i < 33 else "b") for i in range(50)], "product_sku long, good_type string")
    assert O.fixed_split(df, 20).where("split = 'train'").count() == 20
    kept = O.downsample_category(df, "a", 1.5)
    assert kept.where("good_type = 'a'").count() == 33 - 22 and kept.where("good_type = 'b'").count() == 17


def test_rewrite_quirks(spark):
    tagged = spark.createDataFrame(
        [(1, "p", "t", "Hot; warm; NEW; zzz"), (2, "p", "t", "cold; hot"), (3, "q", "nopool", "cold"), (4, "r", "t", None)],
        "comment_id long, product_sku string, good_type string, tags string",
    )
    mapping = spark.createDataFrame(
        [("t", "hot", "warm", 0), ("t", "warm", "cold", 1), ("t", "new", "fresh", 2), ("t", "new", "old", 3), ("t", "gone", "", 4)],
        "good_type string, old_tag string, new_tag string, ord int",
    )
    pool = spark.createDataFrame([("t", "cold"), ("t", "old")], "good_type string, tag string")
    rows = {r["product_sku"]: r["tags"] for r in pools.rewrite_tags(tagged, mapping, pool).collect()}
    assert rows == {"p": ["cold", "old"], "q": [], "r": []}
    chained = {r["product_sku"]: r["tags"] for r in pools.rewrite_tags(tagged, mapping, pool, transitive=True).collect()}
    assert chained["p"] == ["cold", "old"]
    report = pools.rewrite_report(A.product_tags(tagged.where("product_sku = 'r'")), pools.rewrite_tags(tagged.where("product_sku = 'r'"), mapping, pool)).first()
    assert report["reduction_pct"] is None and report["tags_before"] == 0


def test_pending_and_write_back(spark):
    rows = [("a", "ok", ["x"]), ("b", "", ["x"]), ("c", None, ["x"]), ("d", "[FAILED]", ["x"]), ("e", "", [" "])]
    df = spark.createDataFrame(rows, "product_sku string, tags string, comment_text array<string>")
    assert {r["product_sku"] for r in replies.pending_products(df).collect()} == {"b", "c", "d"}
    new = spark.createDataFrame([("b", "new")], "product_sku string, tags string")
    back = {r["product_sku"]: r["tags"] for r in replies.write_back_tags(df, new).collect()}
    assert back == {"a": "ok", "b": "new", "c": None, "d": "[FAILED]", "e": ""}
