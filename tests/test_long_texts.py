"""Windows, leading text and predictions of the long form against those of whole texts."""

import numpy as np
from pyspark.sql import functions as F

from tagweave.operators import long_texts as X
from tagweave.operators import products as A
from tagweave.operators import scoring as S
from tagweave.plans import tagging
from tagweave.sources import artifacts as AR


def reviews(spark):
    rng = np.random.default_rng(6)
    words = np.array(["Good", "bad", "roomy", "x", "", "  ", "very-long-word" * 5, "é"])
    rows = [("hot", i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(500)]
    rows += [(f"p{i}", i, " ".join(rng.choice(words, i))) for i in range(40)] + [("one", 1, "w " * 900), ("none", 1, None), ("blank", 1, " "), (None, 1, "gone")]
    df = spark.createDataFrame(rows, "product_sku string, comment_id long, comment_text string")
    return df.withColumns({"name": F.lit("Name"), "good_type": F.concat(F.lit("t "), F.substring("product_sku", 1, 1)), "good_subtype": F.lit(None).cast("string")}).repartition(5)


def test_windows_and_leads_are_those_of_the_whole_text(spark):
    df = reviews(spark)
    whole = A.aggregate_products(df).select("product_sku", "good_type", "text")
    pieces = A.product_text_chunks(df, 80)
    want = S.token_windows(whole.withColumn("tokens", S.blank_tokens("text")), "tokens", 12, 4)
    want = {(r.product_sku, r.good_type, r.chunk_id): " ".join(r.window) for r in want.collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        windows = X.piece_windows(pieces, 12, 4, carry=whole.select("product_sku", "good_type"))
        got = [((r.product_sku, r.good_type, r.chunk_id), r.text) for r in windows.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(want) > 500 and dict(got) == want
    leads = {r.product_sku: r.text for r in X.lead_text(pieces, 70).collect()}
    assert leads == {r.product_sku: r.text[:70] for r in whole.collect()}


def test_prediction_with_a_reranker(spark):
    labels = spark.createDataFrame([("roomy",), ("good",)], "label string")
    artifacts = AR.Artifacts(labels, AR.threshold_table(labels.withColumn("threshold", F.lit(0.5)), spark.createDataFrame([(0.5,)], "threshold double")), top_k=2)

    def scorer(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame(
                [(r.product_sku, r.good_type, r.chunk_id, w, float(w in r.text.split(" "))) for r in pdf.itertuples() for w in ("roomy", "good")],
                columns=["product_sku", "good_type", "chunk_id", "label", "prob"],
            )

    def client():
        def send(prompt):
            import json

            text = prompt.split("\x01")[0]
            assert len(text) <= 50
            return json.dumps({"tags": [{"tag": "good", "score": len(text) / 100}]})

        return send

    df = reviews(spark)
    whole = {r.product_sku: r.text for r in A.aggregate_products(df).collect()}
    plain = {r.product_sku: [] for r in df.collect() if r.product_sku}
    for r in tagging.predict_long(df, scorer, artifacts, size=12, overlap=4).collect():
        plain[r.product_sku].append((r["rank"], r.label, r.prob))
    for sku, found in plain.items():
        has = [w for w in ("good", "roomy") if w in whole[sku].lower().split(" ")]
        assert [x[1:] for x in sorted(found)] == ([(w, 1.0) for w in has] or [("good", 0.0)])
    better = tagging.predict_long(df, scorer, artifacts, size=12, overlap=4, reranker=client, template="{text}\x01{candidates}\x01{max_return}", max_input_chars=50)
    for r in better.collect():
        if "good" in whole[r.product_sku].lower().split(" "):
            assert (r.label, r.prob) == ("good", len(whole[r.product_sku].strip()[:50]) / 100)


def test_a_range_is_cut_into_stretches_of_bounded_size(spark, monkeypatch):
    """One range holds all pieces here; what a worker holds at once must not grow with it."""
    df = reviews(spark)
    whole = A.aggregate_products(df).select("product_sku", "good_type", "text")
    pieces = A.product_text_chunks(df, 80).coalesce(1)
    want = S.token_windows(whole.withColumn("tokens", S.blank_tokens("text")), "tokens", 12, 4)
    want = {(r.product_sku, r.good_type, r.chunk_id): " ".join(r.window) for r in want.collect()}
    stored, kept = X.durable, []

    def durable(df):
        kept.append(stored(df))
        return kept[-1]

    monkeypatch.setattr(X, "durable", durable)
    windows = X.piece_windows(pieces, 12, 4, carry=whole.select("product_sku", "good_type"), stretch_chars=300)
    got = [((r.product_sku, r.good_type, r.chunk_id), r.text) for r in windows.collect()]
    assert len(got) == len(want) and dict(got) == want
    sizes = kept[0].groupBy("_task").agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("_tokens", F.lit(0), lambda a, t: a + F.length(t) + 1)).alias("chars"))
    assert sizes.where("chars > 310 and n > 1").count() == 0 and sizes.count() > 20


def test_chunks_of_a_product_do_not_gather_behind_its_head(spark):
    pieces = A.product_text_chunks(reviews(spark), 80)
    plan = pieces._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" not in plan and "Join RightOuter" not in plan
    texts = {}
    for r in pieces.orderBy("product_sku", "chunk_id").collect():
        texts.setdefault(r.product_sku, []).append(r.text)
    whole = {r.product_sku: r.text for r in A.aggregate_products(reviews(spark)).collect()}
    assert {k: " ".join(v) for k, v in texts.items()} == whole and {"none", "blank"} <= set(whole)
