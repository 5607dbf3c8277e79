"""Ranked lexical search against plain scoring of every document: ties, copies, long texts, blocks of items, small shards."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tagweave.llm import lexical_search as X

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, k=10):
    """(item, rank, doc, score) of every document scored plainly."""
    counted = [(i, Counter(words(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in counted:
            score, m = 0, 10 + (90 * sum(c.values()) * n_docs) // max(total, 1)
            for w in set(words(text)) & c.keys():
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                score += weight * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort()
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def frames(spark, texts, items, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("x") for c in ("term", "rank", "_item", "_block", "item_id")})
    return docs, spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1)), list(zip(ids, texts, strict=True))


def test_given_tables(spark):
    docs, items = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(X.ranked_documents(docs, items)) == want
    # Tries of a few documents, several blocks of items: the same rows.
    assert rows(X.ranked_documents(docs, items, block_bytes=4000, shard_postings=300)) == want


def test_odd_texts_ties_copies_and_repeated_rows(spark, odd_texts):
    texts = [*odd_texts, "Zebra-42 ÄPFEL äpfel", "zebra 42 äpfel", "zebra", "zebra", "ZEBRA", "zebra null", "zebra", "x zebra " * 5000, "zebra" * 400]
    ids = [*range(len(odd_texts)), 100, 101, 109, 108, 108, None, 107, 106, 105]
    items = [(1, "Zebra 42 Äpfel"), (2, "zebra zebra"), (2, "zebra zebra"), (3, ""), (4, None), (5, "nowhere"), (6, "the same text here x a"), (None, "ab"), (7, "zebra" * 400), (8, "- ."), (2, "a b")]
    docs, table, plain_docs = frames(spark, texts, items, ids)
    want = plain(plain_docs, list(dict.fromkeys(items)), 4)
    assert rows(X.ranked_documents(docs, table, 4)) == want
    assert rows(X.ranked_documents(docs, table, 4, block_bytes=30, shard_postings=1)) == want
    assert X.ranked_documents(docs.where("false"), table).count() == 0
    assert X.ranked_documents(docs, table.where("false")).count() == 0
    assert X.ranked_documents(docs.where("text is null"), table).count() == 0


def test_hot_copies_and_shared_prefixes(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{int(i)}" for i in np.floor(rng.pareto(0.7, 4000) * 3) % 200]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 60))) for _ in range(600)]
    texts += [texts[0]] * 300 + [f"{texts[1]} w{i % 7}" for i in range(100)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 12)))) for i in range(30)] + [(99, texts[0]), (98, texts[1])]
    docs, table, plain_docs = frames(spark, texts, items)
    want = plain(plain_docs, items)
    assert rows(X.ranked_documents(docs.repartition(5), table)) == want
    assert rows(X.ranked_documents(docs.repartition(3), table, shard_postings=2000)) == want


def test_branch_and_bound_leaves_documents_out():
    rng = np.random.default_rng(7)
    n, n_terms = 5000, 300
    entries = np.full(n, 8)
    term = np.concatenate([rng.choice(n_terms, 8, replace=False, p=np.arange(1, n_terms + 1) / (n_terms * (n_terms + 1) / 2)) for _ in range(n)])
    tf, m = rng.integers(1, 5, 8 * n), rng.integers(10, 300, n)
    trie = X.Trie(X.Shard.of(list(range(n)), entries, term, tf, m, 10), n_terms)
    weight = np.zeros(n_terms + 1, np.int64)
    weight[[2, 5, 40, 41, 200, 299]] = [7000, 6800, 4000, 3900, 800, 5]
    best = X.Best(10)
    scored = trie.search(weight, best)
    every = trie.scores(np.arange(len(trie.shard.m)), weight)
    want = sorted((-int(s), i) for s, ids in zip(every.tolist(), trie.shard.ids, strict=True) for i in ids if s > 0)[:10]
    assert [(s, d) for s, _, d in best.found] == want
    assert scored < n / 2
