"""Exact duplicates against plain grouping: odd inputs, huge texts in pieces, forced collisions, hot groups."""

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tagweave.llm import exact_dedup as X

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UPPER)].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), sha) for i in ids]
    return sorted(out, key=str)


def check(docs, rows, **sizes):
    found = X.exact_groups(docs, **sizes).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == plain(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found}) and all(r.doc_id == r.keep_id for r in kept)


def test_fingerprints_put_together_are_those_of_the_whole():
    rng = np.random.default_rng(3)
    p = int(X.MODULUS)
    for size in (0, 1, 3, 4, 5, 63, 64, 65, 1000, 5001):
        text = rng.integers(0, 256, size).astype(np.uint8).tobytes()
        words = np.frombuffer(text + bytes(-size % 4), "<u4").tolist()
        want = 0
        for w in words:
            want = (want * X.BASE + w) % p
        for chunk in (4, 64, 1 << 16):
            assert int(X.text_hashes([b"x", text, b""], chunk_bytes=chunk)[0][1]) == want
        pieces = X.Huge(None, 0)
        for i in range(0, size, 128):
            pieces.add(text[i : i + 128], X.BASE, 64)
        assert int(pieces.hash[0]) == want and pieces.sha.digest() == hashlib.sha256(text).digest()


def test_products_modulo_the_prime():
    p = int(X.MODULUS)
    a = np.array([0, 1, p - 1, p - 1, 2**60 + 12345, 2**31, 987654321987654321], np.uint64)
    b = np.array([p - 1, p - 1, p - 1, 2, 2**60 + 99, 2**31, 123456789123456789], np.uint64)
    assert X.times(a, b).tolist() == [x * y % p for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_odd_texts_nulls_and_repeated_rows(make_docs, odd_texts):
    texts = [*odd_texts, "AbÄ", "aBÄ", "abä", None, "", "null id", "NULL ID", "null only", "same text here", "same text here"]
    ids = [*range(len(odd_texts)), 100, 101, 102, 103, 104, None, 106, None, 7, 7]
    docs, rows = make_docs(texts, ids), list(zip(ids, texts, strict=True))
    check(docs, rows)
    # Tiny pieces, chunks, filter and memory: the same groups.
    check(docs, rows, piece_bytes=64, chunk_bytes=8, filter_bits=64, held_bytes=1)
    assert X.exact_groups(make_docs([])).count() == 0


def test_equal_fingerprints_of_different_texts_are_told_apart(make_docs):
    # In base 1 a fingerprint is a sum of words: texts of the same words in another order collide.
    texts = ["abcdefgh", "efghabcd", "ABCDefgh", "efghabcd", "abcdefgh" * 9, "efghabcd" * 9, "efgh" * 9 + "abcd" * 9, "efghABCD" * 9, "abcdefgh" * 9]
    docs, rows = make_docs(texts), list(enumerate(texts))
    assert len({int(h) for h in X.text_hashes([t.lower().encode() for t in texts], base=1)[0]}) == 2
    check(docs, rows, base=1)
    check(docs, rows, base=1, piece_bytes=16, chunk_bytes=8, held_bytes=1)


def test_hot_group_over_many_tasks(spark, make_docs):
    texts = ["Copy of a text"] * 700 + [f"own text {i}" for i in range(1300)] + ["other copy"] * 100
    docs = make_docs(texts).repartition(13)
    check(docs, list(enumerate(texts)))
    rows = X.carriers(X._pieces(docs, "doc_id", "text", X.PIECE_BYTES), np.full(8, 255, np.uint8), X.BASE, X.PIECE_BYTES, X.CHUNK_BYTES, X.HELD_BYTES)
    sent = rows.where("_at is not null").select(F.col("_chunk").cast("string").alias("t")).collect()
    # One carrier per task and text, however often it is there.
    assert sum(r.t == "copy of a text" for r in sent) <= 13


def test_without_copies_keeps_columns(spark, make_docs):
    rows = [(1, "A b", "x"), (2, "a B", "y"), (2, "a b", "z"), (3, None, "n"), (4, "", "e"), (None, "c", "null"), (None, "c", "null"), (5, "ab", "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _own string").withColumn("_SHA", F.lit(1))
    found = X.without_copies(docs)
    assert found.columns == docs.columns
    kept = sorted(((r.doc_id, r._own) for r in found.collect()), key=str)
    assert [i for i, _ in kept] == [2, 4, 5, None] and ("y" in kept[0][1] or "z" in kept[0][1])
