import json

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tagweave.operators import metrics as M
from tagweave.operators import priors as R
from tagweave.operators import products as A
from tagweave.operators import replies as Q
from tagweave.operators import scoring as S
from tagweave.plans import tagging
from tagweave.sources import artifacts as AR
from tagweave.sources import tables as TB


def test_ask_stores_and_reuses_replies(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def client(folder=str(log)):
        import uuid

        def send(prompt):
            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            if prompt == "bad":
                raise RuntimeError("down")
            return "" if prompt == "silent" else prompt.upper()

        return send

    store = str(tmp_path / "store")
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, "silent"), (5, None)], "id int, prompt string")
    first = {r["id"]: (r["reply"], r["status"]) for r in Q.ask(df, client, store=store).collect()}
    assert first == {1: ("A", "ok"), 2: ("A", "ok"), 3: (None, "failed"), 4: ("", "empty"), 5: (None, None)}
    assert len(list(log.iterdir())) == 3
    Q.ask(df, client, store=store).collect()
    assert len(list(log.iterdir())) == 4  # only the failed prompt is sent again


def test_rerank_falls_back_per_product(spark):
    scores = spark.createDataFrame(
        [(p, "t", lab, x) for p in "12" for lab, x in (("a", 0.9), ("b", 0.6), ("c", 0.0))], "product_sku string, good_type string, label string, prob double"
    )
    texts = spark.createDataFrame([("1", "good"), ("2", "fails")], "product_sku string, text string")
    art = AR.Artifacts(
        scores.select("label").distinct(), spark.createDataFrame([(None, 0.5)], "label string, threshold double"), top_k=8
    )

    def client():
        def send(prompt):
            assert "3. " not in prompt  # zero-probability labels are not offered
            if "fails" in prompt:
                raise RuntimeError
            return json.dumps({"tags": [{"tag": "b", "score": 1}, {"tag": "b", "score": 0.5}]})

        return send

    chunk = scores.withColumn("chunk_id", F.lit(0))
    got = tagging.predict_from_scores(chunk, art, per_label=False, reranker=client, texts=texts)
    rows = sorted((r["product_sku"], r["rank"], r["label"], r["prob"]) for r in got.collect())
    assert rows == [("1", 1, "b", 1.0), ("1", 2, "b", 0.5), ("2", 1, "a", 0.9), ("2", 2, "b", 0.6)]


def test_apply_replies_sort_and_dedupe(spark):
    reply = json.dumps([{"tag": "a", "score": 0.1}, {"tag": "b", "score": 0.9}, {"tag": "a", "score": 0.5}])
    df = spark.createDataFrame([("1", "t", [("a", 0.3), ("b", 0.2)], reply)], "product_sku string, good_type string, candidates array<struct<tag:string,score:double>>, reply string")
    got = [(r["label"], r["prob"]) for r in Q.apply_rerank_replies(df, sort=True, dedupe=True).orderBy("rank").collect()]
    assert got == [("b", 0.9), ("a", 0.1)]


def test_tagging_in_chunks_merges_spellings(spark):
    df = spark.createDataFrame([("p", ["one", "two ", " "], "n", "t", "s")], "product_sku string, comment_text array<string>, name string, good_type string, good_subtype string")

    def client():
        return lambda p: '{"tags": ["Soft", "%s"]}' % ("first" if "one" in p else "SOFT")

    template = "{name} {chunk}/{chunks}\n{reviews}"
    prompts = [r["prompt"] for r in Q.tag_prompts(df, template, max_chars=3).orderBy("chunk_id").collect()]
    assert prompts == ["n 1/2\n1. one", "n 2/2\n1. two"]
    assert Q.tag_with_client(df, client, template, max_chars=3).first()["tags"] == ["Soft", "first"]


def test_csv_with_bom_and_required_columns(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('﻿comment_id;product_sku;comment_text;name;extra\n1;S1;"a ""q""\nline";N;x\n2;S2;b;;y\n', encoding="utf-8")
    rows = TB.read_reviews(spark, str(path), sep=";").orderBy("comment_id").collect()
    assert [tuple(r) for r in rows] == [(1, "S1", 'a "q"\nline', "N"), (2, "S2", "b", None)]
    with pytest.raises(ValueError, match="good_type"):
        TB.read_reviews(spark, str(path), sep=";", required=("good_type",))


def test_grouped_csv_and_mapping_file(spark, tmp_path):
    df = spark.createDataFrame([("p", [1, 2], ["a;b", 'q"x'], ["t1", "t2"])], "product_sku string, comment_id array<long>, comment_text array<string>, tags array<string>")
    TB.write_table(df, str(tmp_path / "g"), "csv")
    row = TB.read_reviews(spark, str(tmp_path / "g")).first()
    assert row["comment_id"] == "[1,2]" and json.loads(row["comment_text"]) == ["a;b", 'q"x'] and row["tags"] == "t1; t2"
    f = tmp_path / "m.csv"
    f.write_text("good_type,old_tags,new_tag\nt,A; b,New \nt,b,\nt,,x\n", encoding="utf-8")
    from tagweave.operators.pools import latest_rules

    rules = {(r["old_tag"], r["new_tag"]) for r in latest_rules(TB.read_tag_mapping(spark, str(f))).collect()}
    assert rules == {("a", "new"), ("b", "")}


def test_files_of_other_column_order_and_late_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text("comment_id,product_sku,comment_text,name\n1,s1,t1,n1\n", encoding="utf-8")
    (tmp_path / "b [x].csv").write_text('name,comment_text,product_sku,comment_id\nn2,t2,s2,"[2, 3]"\n', encoding="utf-8")
    rows = {r["product_sku"]: (r["comment_id"], r["comment_text"], r["name"]) for r in TB.read_reviews(spark, str(tmp_path)).collect()}
    assert rows == {"s1": ("1", "t1", "n1"), "s2": ("[2, 3]", "t2", "n2")}


def test_rules_of_the_later_file_win(spark, tmp_path):
    # The later file is the larger one, so that Spark reads it first.
    (tmp_path / "a.csv").write_text("good_type,old_tags,new_tag\nt,old,first\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("new_tag,good_type,old_tags\n" + "".join(f"x,t,filler{i}\n" for i in range(500)) + "last,t,old\n", encoding="utf-8")
    from tagweave.operators.pools import latest_rules

    rules = latest_rules(TB.read_tag_mapping(spark, str(tmp_path))).where("old_tag = 'old'").collect()
    assert [r["new_tag"] for r in rules] == ["last"]
    with pytest.raises(ValueError):
        TB.read_tag_mapping(spark.createDataFrame([("t", "a", "b")], "good_type string, old_tags string, new_tag string"))


def test_intermediates_go_with_their_run_folder(spark, tmp_path):
    from pathlib import Path

    from tagweave.operators.layout import durable, run_folder

    with run_folder(spark) as folder:
        assert durable(spark.range(5)).count() == 5 and Path(folder.removeprefix("file:")).exists()
    assert not Path(folder.removeprefix("file:")).exists()


def test_an_unreadable_store_is_no_empty_store(spark, tmp_path):
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "part-0.parquet").write_text("not parquet", encoding="utf-8")
    assert Q.read_replies(spark, str(tmp_path / "none")) is None
    with pytest.raises(Exception, match="(?i)parquet"):
        Q.read_replies(spark, str(tmp_path / "store"))


def test_prepare_fit_predict_evaluate(spark):
    rows = []
    for i in range(120):
        kind, good = ("Bags", "roomy") if i % 2 else ("Shoes", "comfy")
        rows += [(2 * i, f"p{i}", f"very {good} item number", kind, f"{good}; nice"), (2 * i + 1, f"p{i}", "like it", kind, "rare%d" % i)]
    df = spark.createDataFrame(rows, "comment_id long, product_sku string, comment_text string, good_type string, tags string")
    pool = spark.createDataFrame([("Bags", "roomy; nice"), ("Shoes", "comfy; nice")], "good_type string, tags string")
    ds = tagging.prepare_dataset(df, pool)
    assert {r["label"] for r in ds.vocab.collect()} == {"roomy", "comfy", "nice"}
    assert ds.products.count() == 120 and ds.windows.count() == 120
    train = ds.products.where("split = 'train'")
    products, truth = train.select("product_sku", "good_type"), ds.truth.where("split = 'train'")
    docs = train.withColumn("tokens", S.blank_tokens("text"))
    weights, bias = S.fit_scorer(docs, truth, products), S.label_bias(truth, products)
    chunks = S.score_tokens(ds.windows.withColumnRenamed("window", "tokens"), weights, bias)
    stats = R.category_label_stats(truth.select("product_sku", "good_type", "label"), products)
    thresholds = AR.threshold_table(
        M.tune_label_thresholds(chunks.select("product_sku", "label", "prob"), ds.truth.select("product_sku", "label"), ds.vocab),
        spark.createDataFrame([(0.5,)], "threshold double"),
    )
    art = AR.Artifacts(ds.vocab, thresholds, ds.allowed, R.category_priors(stats, ds.vocab), category_prior_weight=0.5)
    pred = tagging.predict_from_scores(chunks, art)
    test_truth = ds.truth.join(ds.products.where("split = 'test'").select("product_sku").distinct(), "product_sku", "left_semi")
    test_pred = pred.join(test_truth.select("product_sku").distinct(), "product_sku", "left_semi")
    assert M.multilabel_metrics(test_pred, test_truth, ds.vocab).first()["micro_f1"] == 1.0


def test_predict_tags_with_user_scorer(spark):
    def scorer(batches):
        for pdf in batches:
            yield pd.DataFrame(
                [(s, g, c, lab, 0.9 if lab in t else 0.1) for s, g, t in zip(pdf.product_sku, pdf.good_type, pdf.text) for c in (0, 1) for lab in ("soft", "red")],
                columns=["product_sku", "good_type", "chunk_id", "label", "prob"],
            )

    df = spark.createDataFrame([("1", "t", "soft"), ("2", "t", "none")], "product_sku string, good_type string, text string")
    art = AR.Artifacts(spark.createDataFrame([("soft",), ("red",)], "label string"), spark.createDataFrame([("soft", 0.5), ("red", 0.5), (None, 0.4)], "label string, threshold double"))
    got = {(r["product_sku"], r["label"]) for r in tagging.predict_tags(df, scorer, art).collect()}
    assert got == {("1", "soft"), ("2", "red")}


def test_predict_by_group_with_reranker(spark):
    from tagweave.plans.registry import digest_scorer

    df = spark.createDataFrame([("1", "en", "keep"), ("2", "de", "fail")], "product_sku string, good_type string, text string")
    routes = spark.createDataFrame([("en", "en")], "good_type string, group_key string")

    def client():
        def send(prompt):
            if "fail" in prompt:
                raise RuntimeError
            return '{"tags": [{"tag": "gamma", "score": 0.7}, {"tag": "omega", "score": 1}]}'

        return send

    plain = S.predict_by_group(df, routes, digest_scorer, default="other")
    got = S.predict_by_group(df, routes, digest_scorer, default="other", reranker=client)
    key = lambda d, sku: sorted((r["label"], r["prob"]) for r in d.where(F.col("product_sku") == sku).collect())
    assert key(got, "1") == [("gamma", 0.7)] and key(got, "2") == key(plain, "2")


def test_predict_by_group_reads_long_texts_in_pieces(spark):
    import hashlib

    rows = [(f"p{i % 3}", i, f"review {i} " * 9) for i in range(200)]
    reviews = spark.createDataFrame(rows, "product_sku string, comment_id long, comment_text string").withColumn("good_type", F.lit("en"))
    whole = A.aggregate_products(reviews).select("product_sku", "good_type", "text")
    pieces = A.product_text_chunks(reviews, 300).withColumn("good_type", F.lit("en"))
    assert pieces.count() > 50

    def scorer(batches):
        found, longest = {}, 0
        for pdf in batches:
            for sku, kind, text in zip(pdf["product_sku"], pdf["good_type"], pdf["text"]):
                found[sku, kind] = [*found.get((sku, kind), []), text]
                longest = max(longest, len(text))
        out = [(sku, kind, 0, label, int(hashlib.md5((label + " ".join(t)).encode()).hexdigest()[:4], 16) / 65535) for (sku, kind), t in found.items() for label in "abcdef"]
        yield pd.DataFrame([*out, *([("longest", "en", 0, "n", longest / 1e5)] if out else [])], columns=["product_sku", "good_type", "chunk_id", "label", "prob"])

    def chosen(df, **kwargs):
        found = {(r.product_sku, r.label): (r.prob, r.rank) for r in S.predict_by_group(df, spark.createDataFrame([("en", "en")], "good_type string, group_key string"), scorer, **kwargs).collect()}
        return found, found.pop(("longest", "n"))[0] * 1e5

    want, longest = chosen(whole)
    # Pieces that stand twice count once, and arrive in order.
    got, piece = chosen(pieces.unionAll(pieces).repartition(7), piece="chunk_id")
    assert got == want and piece < 400 < longest


def test_a_pool_reply_is_parsed_once_for_both_results(spark):
    from tagweave.operators import pools

    reply = '{"kept_tags": ["Red"], "mappings": [{"old": ["Rot"], "new": "red"}]}'
    kept, rules = pools.filter_pool(spark.createDataFrame([("a", reply), ("a", None)], "good_type string, reply string"))
    assert kept.collect() == [("a", "red")] and rules.collect() == [("a", "rot", "red", 0)]
    for out in (kept, rules):
        assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()
