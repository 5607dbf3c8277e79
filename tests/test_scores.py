import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tagweave.operators import labels as L
from tagweave.operators import metrics as M
from tagweave.operators import priors as R
from tagweave.operators import scoring as S
from tagweave.operators import selection as C
from tagweave.plans import tagging

SCHEMA = "product_sku string, good_type string, label string, prob double"


def scores(spark, table):
    return spark.createDataFrame([(p, "t", lab, float(x)) for p, row in table.items() for lab, x in row.items()], SCHEMA)


def chosen(df):
    out = {}
    for r in df.orderBy("product_sku", "rank").collect():
        out.setdefault(r["product_sku"], []).append(r["label"])
    return out


def test_select_tags_rules(spark):
    s = scores(spark, {
        "many": {"a": 0.9, "b": 0.8, "c": 0.7, "d": 0.6}, "none": {"a": 0.1, "b": 0.2, "c": 0.2, "d": 0.0},
        "masked": {"a": 0.0, "b": 0.0, "c": 0.0, "d": 0.0}, "own": {"a": 0.55, "b": 0.5, "c": 0.1, "d": 0.58},
    })
    thr = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.5), ("d", 0.6)], "label string, threshold double")
    got = chosen(C.select_tags(s, thr, top_k=2))
    assert got == {"many": ["a", "b"], "none": ["b"], "masked": ["a"], "own": ["a", "b"]}
    assert chosen(C.select_tags(s, thr, top_k=1, mode="by_prob"))["own"] == ["d"]
    free = chosen(C.select_tags(s, thr, top_k=None, min_tags=0))
    assert "none" not in free and len(free["many"]) == 4
    assert C.select_tags(s, 0.85).where("product_sku = 'many'").count() == 1


def test_prior_fallback_and_key(spark):
    s = spark.createDataFrame([("p", " t ", "a", 0.5), ("q", "u", "a", 0.5)], SCHEMA)
    pri = spark.createDataFrame([("t", "a", 1.0), (None, "a", -1.0)], "good_type string, label string, prior_logit double")
    get = lambda df: {r["product_sku"]: round(r["prob"], 4) for r in df.collect()}
    up, down = round(1 / (1 + math.exp(-1)), 4), round(1 / (1 + math.exp(1)), 4)
    assert get(C.blend_prior(s, pri, 1.0, fallback=False, strip_key=True)) == {"p": up, "q": 0.5}
    assert get(C.blend_prior(s, pri, 1.0, fallback=True, strip_key=False)) == {"p": down, "q": down}
    assert get(C.blend_prior(s, pri, 0.0)) == {"p": 0.5, "q": 0.5}


def test_allow_list(spark):
    s = spark.createDataFrame([("p", "t", "a", 0.5), ("p", "t", "b", 0.5), ("q", "free", "b", 0.5)], SCHEMA)
    allowed = spark.createDataFrame([("t", "a")], "good_type string, label string")
    got = {(r[0], r[2]): r["prob"] for r in C.apply_allow_list(s, allowed).collect()}
    assert got == {("p", "a"): 0.5, ("p", "b"): 0.0, ("q", "b"): 0.5}


def test_priors_and_baseline(spark):
    truth = spark.createDataFrame([("1", "t", "a"), ("2", "t", "a"), ("2", "t", "b")], "product_sku string, good_type string, label string")
    products = spark.createDataFrame([("1", "t"), ("2", "t"), ("3", "empty"), ("4", "new")], "product_sku string, good_type string")
    vocab = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    stats = R.category_label_stats(truth, products.where("good_type <> 'new'"))
    pri = {(r[0], r[1]): r[2] for r in R.category_priors(stats, vocab).collect()}
    assert len(pri) == 9 and pri[("t", "a")] == pytest.approx(math.log(0.75 / 0.25)) and pri[(None, "c")] == pytest.approx(math.log(0.2 / 0.8))
    base = R.category_topk_baseline(products, stats, vocab, 2)
    got = {}
    for r in base.collect():
        got.setdefault(r["product_sku"], set()).add(r["label"])
    assert got == {k: {"a", "b"} for k in "1234"}
    three = R.category_topk(stats, vocab, 3).where("good_type = 't'")
    assert three.count() == 3


def test_metrics_by_hand(spark):
    pred = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a")], "product_sku string, label string")
    truth = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "a")], "product_sku string, label string")
    vocab = spark.createDataFrame([("a",), ("b",), ("never",)], "label string")
    products = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "product_sku string")
    m = M.multilabel_metrics(pred, truth, vocab, products=products).first()
    assert m["micro_precision"] == pytest.approx(1 / 3) and m["micro_recall"] == pytest.approx(1 / 3)
    assert m["macro_f1"] == pytest.approx((0.5 + 0 + 0) / 3) and m["avg_pred_tags"] == 0.75
    assert M.subset_accuracy(pred, truth, products).first()["subset_accuracy"] == 0.25
    empty = M.multilabel_metrics(pred.limit(0), truth.limit(0), vocab).first()
    assert empty["micro_f1"] == 0.0 and empty["macro_f1"] == 0.0
    assert M.avg_predicted_tags(pred.limit(0), products.limit(0)).first()[0] == 0.0


def test_threshold_tuning_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(str(i), lab, float(round(rng.random(), 3)), int(rng.random() < 0.3)) for i in range(200) for lab in "abc"]
    rows += [(str(i), "none", 0.9, 0) for i in range(5)] + [("x", "a", 0.6, 1), ("y", "a", 0.05, 1), ("z", "b", 0.95, 0)]
    s = spark.createDataFrame([(p, "t", lab, x) for p, lab, x, _ in rows], SCHEMA)
    t = spark.createDataFrame([(p, lab) for p, lab, _, y in rows if y], "product_sku string, label string")
    vocab = spark.createDataFrame([("a",), ("b",), ("c",), ("none",), ("unseen",)], "label string")

    def best(sub, steps):
        top, out = -1.0, 0.35
        for thr in np.linspace(0.05, 0.95, steps):
            tp = sum(1 for *_, x, y in sub if x >= thr and y)
            n = sum(1 for *_, x, _ in sub if x >= thr) + sum(y for *_, y in sub)
            f1 = 2 * tp / n if n else 0.0
            if f1 > top:
                top, out = f1, float(thr)
        return out, top

    got = M.tune_global_threshold(s, t).first()
    want = best(rows, 37)
    assert got["threshold"] == want[0] and got["f1"] == pytest.approx(want[1])
    per = {r["label"]: r["threshold"] for r in M.tune_label_thresholds(s, t, vocab).collect()}
    assert per == {**{lab: best([r for r in rows if r[1] == lab], 19)[0] for lab in "abc"}, "none": 0.35, "unseen": 0.35}


def test_losses_by_hand(spark):
    p, w = 0.3, 4.0
    s = spark.createDataFrame([("1", "t", "a", p), ("1", "t", "b", p)], SCHEMA)
    t = spark.createDataFrame([("1", "a")], "product_sku string, label string")
    weights = spark.createDataFrame([("a", w), ("b", w)], "label string, pos_weight double")
    got = M.loss_report(s, t, pos_weights=weights).first()
    assert got["bce"] == pytest.approx(-(math.log(p) + math.log(1 - p)) / 2)
    assert got["weighted_bce"] == pytest.approx(-(w * math.log(p) + math.log(1 - p)) / 2)
    assert got["focal"] == pytest.approx(-(0.25 * 0.7**2 * math.log(p) + 0.75 * 0.3**2 * math.log(1 - p)) / 2)
    assert got["asl"] == pytest.approx(-(0.7 * math.log(p) + 0.25**4 * math.log(0.75)) / 2)
    freq = spark.createDataFrame([("a", 1), ("b", 9)], "tag string, n long")
    assert {r[0]: round(r[1], 4) for r in M.positive_weights(freq).collect()} == {"a": 9.0, "b": 0.1111}


def test_vocab_and_multi_hot(spark):
    rows = [("1", "train", "b"), ("2", "train", "b"), ("1", "train", "a"), ("2", "train", "a"), ("3", "test", "a"), ("3", "test", "new"), ("4", "test", "new")]
    kept, vocab = L.apply_label_vocab(spark.createDataFrame(rows, "product_sku string, split string, tag string"), 2)
    assert [tuple(r) for r in vocab.select("label_id", "label").orderBy("label_id").collect()] == [(0, "a"), (1, "b")]
    assert {r["product_sku"] for r in kept.collect()} == {"1", "2", "3"}
    df = spark.createDataFrame([(["Качественный принт"],)], "tags array<string>")
    names = ["Качественный", "Качественный принт"]
    assert tuple(L.multi_hot(df, names).select(*[f"`{n}`" for n in names]).first()) == (0, 1)
    assert tuple(L.multi_hot(df, names, legacy_substring=True).select(*[f"`{n}`" for n in names]).first()) == (1, 1)
    with_ids = L.with_label_ids(spark.createDataFrame([("a",), ("zz",)], "label string"), vocab).collect()
    assert [(r["label"], r["label_id"]) for r in with_ids] == [("a", 0)]


def test_precision_recall_at_k(spark):
    s = scores(spark, {"1": {"a": 0.9, "b": 0.8, "c": 0.1}, "2": {"a": 0.9, "b": 0.2, "c": 0.1}})
    t = spark.createDataFrame([("1", "b"), ("2", "a"), ("2", "c")], "product_sku string, label string")
    got = {r["k"]: (r["precision"], r["recall"]) for r in M.precision_recall_at_k(s, t, [1, 2]).collect()}
    assert got == {1: (0.5, 0.25), 2: (0.5, 0.75)}


def test_route_and_group_placement(spark):
    df = spark.createDataFrame([("1", " Bags "), ("2", "Toys"), ("3", None)], "product_sku string, good_type string")
    routes = spark.createDataFrame([("Bags", "bags")], "good_type string, group_key string")
    routed = S.route_category(df, routes)
    assert {r[0]: r["group_key"] for r in routed.collect()} == {"1": "bags", "2": "accs", "3": "accs"}
    wide = spark.range(5000).select(F.col("id").alias("product_sku"), F.lit("one").alias("group_key"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps small partitions apart
    try:
        used = S.by_group(wide).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert used == 8


def test_rows_without_a_category_count_in_the_total_alone(spark):
    products = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", None), ("4", "b")], "product_sku string, good_type string")
    truth = spark.createDataFrame([("1", "a", "x"), ("3", None, "x"), ("3", None, "y")], "product_sku string, good_type string, label string")
    got = {(r["good_type"], r["label"]): (r["pos"], r["n"]) for r in R.category_label_stats(truth, products).collect()}
    assert got == {("a", "x"): (1, 2), ("b", None): (None, 1), (None, "x"): (1, 4)}


def test_tuning_without_any_pair_gives_the_default(spark):
    scores = spark.createDataFrame([], "product_sku string, label string, prob double")
    truth = spark.createDataFrame([], "product_sku string, label string")
    row = M.tune_global_threshold(scores, truth).first()
    assert (row["threshold"], row["f1"]) == (0.35, 0.0)
    vocab = spark.createDataFrame([("a",)], "label string")
    assert [r["threshold"] for r in M.tune_label_thresholds(scores, truth, vocab).collect()] == [0.35]
    products = spark.createDataFrame([("1", "val")], "product_sku string, split string")
    assert tagging.evaluate(scores, truth, products, vocab).count() == 0


def test_evaluate_in_one_pass_equals_tuning_and_reports_apart(spark):
    import random

    rng = random.Random(3)
    labels, rows, true = [f"l{i}" for i in range(6)], [], []
    for p in range(120):
        for lab in labels:
            hit = rng.random() < 0.25 and lab != "l5"
            if hit:
                true.append((f"p{p}", lab))
            if rng.random() < 0.9:
                rows.append((f"p{p}", lab, min(1.0, max(0.0, rng.gauss(0.6 if hit else 0.35, 0.2)))))
    split = [(f"p{p}", "val" if p % 2 else "test") for p in range(120)]
    scores = spark.createDataFrame(rows, "product_sku string, label string, prob double")
    truth = spark.createDataFrame(true, "product_sku string, label string")
    products = spark.createDataFrame(split, "product_sku string, split string")
    vocab = spark.createDataFrame([(x,) for x in labels], "label string")
    got = {(r["split"], r["mode"]): r for r in tagging.evaluate(scores, truth, products, vocab).collect()}
    inside = lambda df, name: df.join(products.where(F.col("split") == name), "product_sku", "left_semi")
    overall = M.tune_global_threshold(inside(scores, "val"), inside(truth, "val")).first()["threshold"]
    per_label = M.tune_label_thresholds(inside(scores, "val"), inside(truth, "val"), vocab)
    for name in ("val", "test"):
        for mode, limit in (("global", overall), ("per_label", per_label)):
            pred = C.binarize(inside(scores, name), limit).where("passed").select("product_sku", "label")
            want = M.multilabel_metrics(pred, inside(truth, name), vocab, products=products.where(F.col("split") == name)).first()
            assert all(abs(want[c] - got[name, mode][c]) < 1e-9 for c in want.asDict()), (name, mode)


def test_sparse_weights_equal_the_dense_formula(spark):
    import math

    docs = [("1", "g", ["a", "b"], ["x"]), ("2", "g", ["a", "c"], ["x", "y"]), ("3", "g", ["b"], []), ("4", "h", ["a"], ["y"]), ("5", "g", ["c", "d"], ["y"])]
    df = spark.createDataFrame([(i, g, t) for i, g, t, _ in docs], "product_sku string, good_type string, tokens array<string>")
    truth = spark.createDataFrame([(i, lab) for i, _, _, labs in docs for lab in labs], "product_sku string, label string")
    products = df.select("product_sku", "good_type")
    chunks = spark.createDataFrame([("q", "g", 0, ["a", "d", "new"]), ("q", "g", 1, []), ("r", "h", 0, ["a", "a"])], "product_sku string, good_type string, chunk_id int, tokens array<string>")
    out = S.score_tokens(chunks, S.fit_scorer(df, truth, products), S.label_bias(truth, products)).collect()
    tokens = {("q", 0): {"a", "d", "new"}, ("q", 1): set(), ("r", 0): {"a"}}
    assert len(out) == 5
    for r in out:
        own = [d for d in docs if d[1] == r["good_type"]]
        n, pos = len(own), [d for d in own if r["label"] in d[3]]
        x = math.log((len(pos) + 1) / (n - len(pos) + 1))
        for t in tokens[r["product_sku"], r["chunk_id"]]:
            df_all, df_pos = sum(t in d[2] for d in own), sum(t in d[2] for d in pos)
            if df_all:
                x += math.log((df_pos + 1) / (len(pos) + 2)) - math.log((df_all - df_pos + 1) / (n - len(pos) + 2))
        assert abs(r["prob"] - 1 / (1 + math.exp(-x))) < 1e-9


def test_a_weight_is_laid_out_once_not_for_every_token(spark):
    weights = spark.createDataFrame([("a", "x", 0.5, [("red", 2.0)])], "good_type string, token string, drop double, corrections array<struct<label:string,c:double>>")
    bias = spark.createDataFrame([("a", "red", 0.25, -0.5)], "good_type string, label string, bias double, unseen double")
    chunks = spark.createDataFrame([(1, "a", 0, ["x", "y", "x"]), (2, "a", 0, []), (3, "a", 0, ["y"])], "product_sku long, good_type string, chunk_id int, tokens array<string>")
    out = S.score_tokens(chunks, weights, bias)
    got = {r.product_sku: r.prob for r in out.collect()}
    alone = 1 / (1 + math.exp(-0.25))
    assert got == pytest.approx({1: 1 / (1 + math.exp(-1.25)), 2: alone, 3: alone})
    # Above the join with the weights nothing is computed from their corrections.
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[0]
    assert "transform(" not in above


def test_precision_at_k_reads_scores_and_truth_once(spark):
    s = spark.createDataFrame(
        [("a", "x", 0.9), ("a", "y", 0.8), ("a", "z", 0.7), ("b", "x", 0.9), ("b", "y", 0.1), ("untrue", "x", 1.0), (None, "x", 1.0), ("c", None, 0.5)],
        "product_sku string, label string, prob double",
    )
    t = spark.createDataFrame(
        [("a", "y"), ("a", "z"), ("a", "z"), ("b", None), ("unscored", "x"), (None, "x"), ("c", None)], "product_sku string, label string"
    )
    got = M.precision_recall_at_k(s, t, [1, 2])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
    # Products a, b and c count; a's truth is listed thrice.
    rows = {r["k"]: (round(r["precision"], 6), round(r["recall"], 6)) for r in got.collect()}
    assert rows == {1: (0.0, 0.0), 2: (round(0.5 / 3, 6), round(1 / 9, 6))}


def test_tags_are_made_once_not_for_every_label(spark):
    df = spark.createDataFrame([(1, "b;a;b"), (2, ""), (3, None)], "product_sku long, cell string")
    labels = F.array(*[F.lit(x) for x in ("a", "b", "c")])
    out = df.select("product_sku", F.array_sort(F.split("cell", ";")).alias("tags")).select("product_sku", L.multi_hot_vector("tags", labels).alias("hot"))
    assert {r.product_sku: r.hot for r in out.collect()} == {1: [1, 1, 0], 2: [0, 0, 0], 3: [None] * 3}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains(lambda" in plan and "array_contains(array_sort" not in plan


def test_tokens_move_as_numbers_of_a_dictionary(spark):
    """One row for each token of a stretch, not for each token of each chunk."""
    words = [f"w{i}" for i in range(40)]
    chunks = spark.createDataFrame([(p, "g" if p % 3 else None, c, words[p % 5 :] + words[:9]) for p in range(30) for c in range(4)], "product_sku long, good_type string, chunk_id int, tokens array<string>").coalesce(1)
    coded = S.numbered_tokens(chunks)
    assert coded.where("token is null").count() == 120 and coded.where("token is not null").count() == 40
    per_chunk = coded.where("token is null and good_type = 'g'").select(F.length("_numbers").alias("n")).distinct().collect()
    assert {r.n for r in per_chunk} <= {2 * 40, 2 * 39, 2 * 38, 2 * 37, 2 * 36}
    plan = S.score_tokens(chunks, spark.createDataFrame([], "good_type string, token string, drop double, corrections array<struct<label:string,c:double>>"),
                          spark.createDataFrame([("g", "red", 0.25, -0.5)], "good_type string, label string, bias double, unseen double"))
    assert "explode" not in plan._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[1]


def test_numbered_tokens_in_small_stretches_score_like_plain_sums(spark, monkeypatch):
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(70_000)] + [None, ""]
    # The second group's dictionary passes 2^16, repeated chunks add up, and chunks may have no or unknown tokens, or no group.
    rows = [(p, rng.choice("ab"), rng.randrange(2), rng.choices(words[-300:], k=rng.randrange(9))) for p in range(80)] + [(100, "b", 0, words), (101, None, 0, ["w1"]), (102, "a", 0, None)]
    chunks = spark.createDataFrame(rows + rows[:7], "product_sku long, good_type string, chunk_id int, tokens array<string>").coalesce(2)
    known = [(g, w, 0.01 * (i % 7), [(lab, 0.1 * (i % 5) - 0.2) for lab in "xyz" if (i + ord(lab)) % 3 == 0]) for g in "ab" for i, w in enumerate(words[-200:]) if w is not None]
    weights = spark.createDataFrame(known, "good_type string, token string, drop double, corrections array<struct<label:string,c:double>>")
    bias = [(g, lab, 0.3, -0.01) for g in "ab" for lab in "xyz"]
    of = {(g, w): (d, dict(c)) for g, w, d, c in known}
    want = {}
    for p, g, c, tokens in rows + rows[:7]:
        hits = [of[g, t] for t in set(tokens or ()) if (g, t) in of]
        for lab in "xyz" if g else "":
            want[p, g, c, lab] = want.get((p, g, c, lab), 0.3) + sum(-0.01 - d + e.get(lab, 0.0) for d, e in hits)
    for stretch in (50, 1 << 22):
        monkeypatch.setattr(S.numbered_tokens, "__defaults__", ("good_type", stretch))
        out = S.score_tokens(chunks, weights, spark.createDataFrame(bias, "good_type string, label string, bias double, unseen double"))
        got = {(r.product_sku, r.good_type, r.chunk_id, r.label): r.prob for r in out.collect()}
        assert got == pytest.approx({k: 1 / (1 + math.exp(-x)) for k, x in want.items()})
