"""Alignment of two tokenizers against the libraries and a plain walk over byte offsets."""

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tagweave.llm import token_alignment as X
from tagweave.llm.pieces import byte_letters
from tagweave.llm.queries import BYTE_FILE, PATTERN, PIECE_FILE, QUERIES

FOLDER = "/root/testdata/sf0.001"


def library():
    a = Tokenizer.from_file(BYTE_FILE)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=PIECE_FILE)
    byte = {c: i for i, c in enumerate(byte_letters())}

    def both(text):
        if not text:
            return [], []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        raw = (" " + text).encode()
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return [], []
        return list(zip(ids_a, bytes_a, strict=True)), list(zip(ids_b, bytes_b, strict=True))

    return both


def plain(texts):
    both, found, counts = library(), [], Counter()
    for text in texts:
        a, b = both(text)
        owners = []
        for side in (a, b):
            at, owner = 0, []
            for k, (_, raw) in enumerate(side):
                owner += [k] * len(raw)
                at += len(raw)
            owners.append(owner)
        # Every byte links the two tokens that hold it.
        links = sorted(set(zip(*owners, strict=True)))
        ends = [set(np.cumsum([len(r) for _, r in side]).tolist()) for side in (a, b)]
        cuts = sorted(ends[0] & ends[1])
        groups = []
        for c0, c1 in zip([0, *cuts], cuts, strict=False):
            parts = []
            for side, owner in zip((a, b), owners, strict=True):
                parts.append(",".join(str(side[k][0]) for k in sorted(set(owner[c0:c1]))))
            groups.append("|".join(parts))
        pairs = [(a[i][0], b[j][0]) for i, j in links]
        counts.update(pairs)
        found.append((len(a), len(b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "", [list(x) for x in links]))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(n_a, n_b, n_g, len(p), sum(counts[x] == best[x[1]] for x in p), sum(counts[x] for x in p), sha) for n_a, n_b, n_g, p, sha, _ in found], [f[5] for f in found]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


encoders = X.encoder_pair(BYTE_FILE, PATTERN, PIECE_FILE)


def rows(df):
    return sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in df.collect()), key=str)


def test_op12_against_the_libraries(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want, _ = plain([r.text for r in docs])
    assert rows(QUERIES["op12_token_alignment"](spark, FOLDER)) == sorted(((r.doc_id, *w) for r, w in zip(docs, want, strict=True)), key=str)


def test_odd_texts(spark, make_docs, odd_texts):
    texts = [
        *odd_texts, "a▁b", "▁", "x▁ y", " ▁", "<s> <unk> </s>", "<0x41>", "﻿x", "\r\n", "a\rb ;\r", "tab\tand nbsp", "é ﬁ", "\U0001f600 \U0001f468‍\U0001f469", "null id",
        "dup text", "dup text", "ab" * 4000, "word " * 3000 + "x", "日本" * 700, "\n\nx", "x\n", "\nfoo bar",
    ]
    ids = [*range(len(texts) - 1), None]
    docs = make_docs(texts, ids).withColumn("n_a", F.lit("x")).withColumn("bucket", F.lit(1)).withColumn("stretch", F.lit(2))
    want, links = plain(texts)
    expected = sorted(((i, *w) for i, w in zip(ids, want, strict=True)), key=str)
    assert any(w[0] == 0 for w in want) and sum(w[0] > 0 for w in want) > 30
    assert rows(X.alignment_counts(docs, encoders)) == expected
    # Small stretches whose pairs meet in several tasks: the same rows.
    assert rows(X.alignment_counts(docs.repartition(5), encoders, stretch_chars=50, stretches=2)) == expected
    assert X.alignment_counts(make_docs([]), encoders).count() == 0
    assert rows(X.alignment_counts(make_docs([None, ""]), encoders)) == [(0, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")]
    arrays = {r.doc_id: r for r in X.align_documents(docs, encoders).collect()}
    for i, (w, own) in enumerate(zip(want[:-1], links[:-1], strict=True)):
        r = arrays[i]
        assert (len(r.a), len(r.b), len(r.cut_a), len(r.link_a)) == w[:4]
        assert [list(x) for x in zip(r.link_a, r.link_b, strict=True)] == own
        assert not r.a or (r.cut_a[-1], r.cut_b[-1]) == (len(r.a), len(r.b))


def test_lanes_change_nothing():
    rng = np.random.default_rng(11)
    n = rng.integers(0, 400, 50)
    n[7], n[0] = 9000, 0
    ends = [np.cumsum(rng.integers(1, 6, k)) for k in n]
    # The other side: ends of the same last offset, a third of them shared.
    other = [np.unique(np.concatenate((e[rng.random(len(e)) < 0.3], rng.integers(1, e[-1] + 1, len(e)), e[-1:]))) if len(e) else e for e in ends]
    base = np.cumsum([0, *(e[-1] if len(e) else 0 for e in ends)])
    end_a, end_b = (np.concatenate([e + x for e, x in zip(side, base, strict=False)]) for side in (ends, other))
    n_a, n_b = n, np.array([len(e) for e in other])
    one = X.lockstep(end_a, end_b, X.lanes(end_a, end_b, n_a, n_b, 10**9))
    for lane in (1, 7, 64):
        starts = X.lanes(end_a, end_b, n_a, n_b, lane)
        assert len(starts[0]) > np.count_nonzero(n)
        many = X.lockstep(end_a, end_b, starts)
        assert sorted(zip(many[0].tolist(), many[1].tolist(), strict=True)) == sorted(zip(one[0].tolist(), one[1].tolist(), strict=True))
        assert (many[2] == one[2]).all() and (many[3] == one[3]).all()


def test_numbers_come_back():
    for x in (np.empty(0, np.int64), np.zeros(3, np.int64), np.array([1, 2**40, 255, 256])):
        assert X.unpack(X.pack(x)).tolist() == x.tolist()
