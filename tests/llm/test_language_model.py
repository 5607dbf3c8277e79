"""Base scores against plain counting, the filter against exact counts, and held-out text."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyspark.sql.functions as F

from tagweave.llm import language_model as lm
from tagweave.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def base(rows, training):
    counts = Counter(w for i, t in rows if training(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        w = words(t)
        out[i] = (len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    return out


def check(found, want):
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(map(str, want))
    for r in found:
        n, known, total, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, score, rel_tol=1e-9, abs_tol=1e-9)
        assert r.score <= 0 and math.isfinite(r.score)


def test_op8_against_counting(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    want = base(rows, lambda i: not held[i])
    found = QUERIES["op8_language_model"](spark, FOLDER).collect()
    check(found, want)
    assert all(r.held_out == held[r.doc_id] for r in found)
    held_rows = [r for r in found if r.held_out]
    assert sum(r.score for r in held_rows) > sum(r.base_score for r in held_rows)
    # Hardly any word sent to the workers, small buckets: the same sums.
    monkeypatch.setattr(lm, "FREQUENT", 50)
    monkeypatch.setattr(lm, "WORD_BUCKET_BYTES", 20_000)
    monkeypatch.setattr(lm, "PAIR_BUCKET_BYTES", 5_000)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    check(lm.score_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1).collect(), want)


def test_odd_texts(make_docs, odd_texts):
    ids = [*range(len(odd_texts)), None]
    texts = [*odd_texts, "null id ab"]
    docs = make_docs(texts, ids)
    rows = list(zip(ids, texts, strict=True))
    check(lm.score_documents(docs, F.col("doc_id") % 3 != 0).collect(), base(rows, lambda i: i is not None and i % 3 != 0))
    check(lm.score_documents(docs, F.lit(False)).collect(), base(rows, lambda i: False))
    assert lm.score_documents(make_docs([]), F.lit(True)).count() == 0
    twice = lm.score_documents(make_docs(["a b", "a b"], [1, 1]), F.lit(True)).collect()
    assert [(r.n_tokens, r.train_tokens) for r in twice] == [(3, 6)] * 2 and twice[0].base_score == twice[1].base_score


def test_filter_gives_levels_back():
    rng = np.random.default_rng(0)
    keys = lm.mix(np.arange(20_000, dtype=np.uint64))
    counts = np.floor(rng.pareto(1.0, len(keys)) * 3 + 1).astype(np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    model = lm.CountFilter(*lm.segment(keys, counts))
    found, true = model.levels(keys), lm.level(counts)
    # A Bloom filter never forgets, and rarely goes a level too far.
    assert (found >= true).all() and (found > true).mean() < 0.03
    assert (model.levels(lm.mix(np.arange(10**6, 10**6 + 20_000, dtype=np.uint64))) > 0).mean() < 0.03
    assert lm.CountFilter(*lm.segment(keys[:0], counts[:0])).levels(keys).sum() == 0


def test_keys_places_and_levels():
    keys = np.array([0, 1, 2**48 - 1, 2**64 - 1], np.uint64)
    assert lm.unpack_keys(lm.pack_keys(keys)).tolist() == keys.tolist() and not len(lm.unpack_keys(lm.pack_keys(keys[:0])))
    assert lm.level(np.array([0, 1, 2, 3, 1000])).tolist() == [0, 1, 2, 3, 18]
    for n in (0, 1, 2, 255, 70_000):
        at = np.random.default_rng(n).integers(0, max(1, n), 3 * n)
        assert lm.unpack_places(lm.pack_places(at, n), len(at), n).tolist() == at.tolist()


def test_scores_are_the_plain_interpolation(spark, monkeypatch):
    # With so many bits no probe hits by chance, so levels are those of the counts.
    monkeypatch.setattr(lm, "BITS_PER_ITEM", 300)
    monkeypatch.setattr(lm, "ASK_TOKENS", 20_000)
    weight = 0.35
    monkeypatch.setattr(lm, "fit_weights", lambda chunks, model: np.full(lm.MAX_LEVEL, weight))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    learnt = {i: zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows}
    ones, pairs = Counter(), Counter()
    for i, t in rows:
        w = words(t)
        if learnt[i]:
            ones.update(w)
            pairs.update(zip([None, *w[:-1]], w, strict=True))
    of = lambda c: 1 + math.floor(math.log(c) / math.log(lm.LEVEL_BASE) + 1e-9)
    means = []
    for counts in (ones, pairs):
        by = {}
        for c in counts.values():
            by.setdefault(of(c), []).append(c)
        means.append({k: sum(v) / len(v) for k, v in by.items()})
    n, v = sum(ones.values()), len(ones)
    mean = lambda kind, c: means[kind][of(c)] if c else 0.0
    want = {}
    for i, t in rows:
        total, w = 0.0, words(t)
        for a, b in zip([None, *w[:-1]], w, strict=True):
            word, context = (mean(0, ones[b]) + 0.5) / (n + 0.5 * (v + 1)), mean(0, ones[a])
            share = min(1.0, mean(1, pairs[a, b]) / context) if context else 0.0
            total += math.log10(weight * share + (1 - weight) * word if context else word)
        want[i] = total
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = lm.score_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1).collect()
    assert all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-6) for r in found) and len(found) == len(want)
