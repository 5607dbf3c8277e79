"""Held-out accuracy of both classifiers, their features against plain loops, and odd tables."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tagweave.llm import quality, toxicity
from tagweave.llm.classifiers import unpack_arrays
from tagweave.llm.common import mix, word_hashes
from tagweave.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.mark.parametrize(
    ("folder", "name", "label", "fold", "rest", "auc"),
    [
        (FOLDER, "op2_quality", "quality", 3, 1, 0.97), (FOLDER, "op5_toxicity", "toxic", 4, 2, 0.8),
        # With ten times the labels to learn from the bound is higher.
        ("/root/testdata/sf0.1", "op5_toxicity", "toxic", 4, 2, 0.9),
    ],
)
def test_held_out_rows(spark, folder, name, label, fold, rest, auc):
    rows = QUERIES[name](spark, folder).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == rest) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.5 if fold == 3 else 0.3)) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pos, neg = ([s for s, y in held if y == c] for c in (1, 0))
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert wins / (len(pos) * len(neg)) > auc


def labelled(spark, rows):
    return spark.createDataFrame([(i, q, t, "clash") for i, q, t in rows], LABELS)


def test_odd_texts_and_labels(spark, make_docs, odd_texts):
    docs = make_docs([*odd_texts, "null id"], [*range(len(odd_texts)), None])
    for labels in ([], [(0, 1, 0)], [(4, 1, 1), (6, 0, 0), (6, None, None), (None, 1, 1), (999, 0, 1), (9, 0, 1), (10, 1, 0)]):
        table = labelled(spark, labels)
        for train, score, keep in (
            (quality.train_quality, quality.score_quality, quality.keep_quality), (toxicity.train_toxicity, toxicity.score_toxicity, toxicity.drop_toxic)
        ):
            model = train(docs, table)
            rows = score(docs, model).collect()
            assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, [*range(len(odd_texts)), None]))
            assert all(0 <= r.score <= 1 for r in rows)
            kept = keep(docs, model)
            assert kept.schema == docs.schema
            wanted = [r for r in rows if (r.predicted if train is quality.train_quality else not r.predicted)]
            assert kept.count() == len(wanted)
            assert score(docs.limit(0), model).count() == 0


def test_scores_do_not_depend_on_neighbours(spark, make_docs):
    rng = np.random.default_rng(0)
    samples = [rng.integers(0, 2**63, rng.integers(1, 30)).astype(np.uint64) for _ in range(40)]
    model = toxicity.fit([{"words": w} for w in samples], np.arange(40) % 2)
    texts = ["you are a clown", "", "a", "ein text der das ist", "word " * 500]
    for scorer, m in ((toxicity.scorer, model), (quality.scorer, quality.fit([], np.empty(0, np.int64)))):
        score = scorer(m)
        assert np.allclose(score(texts), [score([t])[0] for t in texts])


def test_toxicity_finds_a_word_and_spares_unknown_ones(spark, make_docs):
    rng = np.random.default_rng(5)
    word = lambda: "w" + str(rng.integers(0, 400))
    texts = [" ".join(word() for _ in range(40)) for _ in range(400)]
    labels = [i % 4 == 0 for i in range(400)]
    texts = [t + (" scum " if y else " ") + word() for t, y in zip(texts, labels, strict=True)]
    hashes = [toxicity.tokens([t])[0] for t in texts]
    score = toxicity.scorer(toxicity.fit([{"words": h} for h in hashes], np.array(labels, np.int64)))
    assert score(["w1 w2 scum, w3"])[0] >= toxicity.CUT
    assert score([" ".join(f"never{i}" for i in range(20_000))])[0] < toxicity.CUT
    assert score(["w1 w2 w3 w4"])[0] < toxicity.CUT


def test_languages_are_found_without_labels(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect() if r.text]
    texts = [t for _, t in rows]
    centres = toxicity.language_groups(toxicity.profiles(texts[::2]), np.random.default_rng(11))
    group = toxicity.languages(toxicity.profiles(texts), centres)
    # Of the texts left out, nearly all of a group are of one language.
    left_out = list(zip(group[1::2].tolist(), (lang for lang, _ in rows[1::2]), strict=True))
    common = Counter(left_out)
    pure = sum(max(n for (h, _), n in common.items() if h == g) for g in {g for g, _ in left_out})
    assert pure >= 0.9 * len(left_out)


def test_profiles():
    found = toxicity.profiles(["", "ab", "abc", "ABC", "abcabc" * 400_000, "x" + " " * 50, "abc"])
    assert not found[[0, 1]].any() and np.array_equal(found[2], found[3]) and np.array_equal(found[2], found[6])
    assert np.isclose(np.linalg.norm(found[4]), 1) and toxicity.languages(found[:2], found[2:5]).tolist() == [3, 3]
    assert toxicity.languages(found, toxicity.language_groups(found[:2], np.random.default_rng(0))).tolist() == [0] * 7


def test_word_hashes_are_those_of_single_words():
    texts = [b"ab cd", b"", b"  ", b"ab", b"\xc3\xa9 ab  cd"]
    h, n = word_hashes(texts)
    assert n.tolist() == [2, 0, 0, 1, 3]
    one = lambda w: word_hashes([w])[0][0]
    assert h.tolist() == [one(w) for t in texts for w in t.split()]
    assert len(set(mix(np.arange(1000, dtype=np.uint64)).tolist())) == 1000


def test_quality_features_do_not_cross_documents():
    texts = ["ab cde fghij", "", "x", "ab cde fghij"]
    per_doc = [[], [], [], []]
    for ids, counts in quality.features(texts):
        for i, part in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
            per_doc[i] += sorted(part.tolist())
    assert per_doc[0] == per_doc[3] and not per_doc[1]
    # " ab cde fghij ": words 3, pairs 2, lengths 3 to 5 of what has no space inside.
    padded = [" ab ", " cde ", " fghij "]
    grams = sum(max(0, len(w) - n + 1) for w in padded for n in quality.GRAMS)
    assert len(per_doc[0]) == 3 + 2 + grams


def test_softmax_equals_the_score_table():
    rng = np.random.default_rng(1)
    samples = [{"ids": np.arange(i, i + 5, dtype=np.int32), "share": np.full(5, 0.2, np.float32)} for i in rng.integers(0, 1000, 60)]
    m = unpack_arrays(quality.fit(samples, np.arange(60) % 2))
    mean = m["table"][samples[0]["ids"]].mean(0)
    z = mean @ m["weight"] + m["bias"]
    p = np.exp(z[1]) / np.exp(z).sum()
    q = 1 / (1 + np.exp(-(m["toward"][samples[0]["ids"]].mean() + m["bias"][1] - m["bias"][0])))
    assert np.isclose(p, q, atol=1e-5)


def test_toxicity_learns_from_every_labelled_document(spark, make_docs):
    rng = np.random.default_rng(3)
    clean = [" ".join(f"w{i}" for i in rng.integers(0, 300, 8)) for _ in range(7000)]
    # Each of 1,500 words stands in two of 3,000 toxic documents; what is left out of learning is not found.
    texts = [f"{t} bad{i // 2}" if i < 3000 else t for i, t in enumerate(clean)]
    docs = make_docs(texts)
    table = labelled(spark, [(i, 1, int(i < 3000)) for i in range(7000)])
    scored = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, table)).collect()
    assert sum(r.predicted for r in scored if r.doc_id < 3000) > 0.95 * 3000
    assert sum(r.predicted for r in scored if r.doc_id >= 3000) < 0.05 * 4000


def test_toxicity_in_shards(spark, make_docs):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 400, 40)) + (" scum " if n % 4 == 0 else " ") + "x" for n in range(600)]
    # Repeated rows, a null key and labels of no document change nothing.
    docs = make_docs([*texts, *texts[:50], "scum"], [*range(600), *range(50), None])
    table = labelled(spark, [*((i, 1, int(i % 4 == 0)) for i in range(600)), (7000, 1, 1), (None, 1, 1)])
    model = toxicity.train_toxicity(docs, table, shard_docs=100)
    assert unpack_arrays(model)["table"].any()
    assert model == toxicity.train_toxicity(docs.repartition(7), table.repartition(3), shard_docs=100)
    score = toxicity.scorer(model)
    assert score(["w1 w2 scum, w3"])[0] >= toxicity.CUT > score(["w1 w2 w3 w4"])[0]
    assert score([" ".join(f"never{i}" for i in range(20_000))])[0] < toxicity.CUT
    # One class alone: nothing is learnt, whatever the number of shards.
    one = labelled(spark, [(i, 1, 0) for i in range(600)])
    assert max(r.score for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, one, shard_docs=100)).collect()) < toxicity.CUT


def test_cuts_from_counts_are_those_of_single_scores():
    rng = np.random.default_rng(2)
    labels, language = rng.integers(0, 2, 400), rng.integers(0, 3, 400)
    score = np.clip(rng.normal(0.3 + 0.3 * labels + 0.1 * language, 0.1), 0.01, 0.99)
    whole = toxicity.language_cuts(toxicity.score_counts(score, labels, language), 3)
    parts = [toxicity.score_counts(score[i::2], labels[i::2], language[i::2], 1 << 20) for i in (0, 1)]
    assert np.allclose(whole, toxicity.language_cuts({k: np.concatenate([p[k] for p in parts]) for k in toxicity.COUNTS}, 3))
