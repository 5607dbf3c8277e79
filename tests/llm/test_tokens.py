"""Byte-level BPE, token files and packing against the tokenizer libraries and plain loops."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tagweave.llm import packing, pieces, token_files
from tagweave.llm.byte_bpe import MergeReplay, decode_documents, encode_documents, read_ranks, round_trip_digests
from tagweave.llm.queries import BYTE_FILE, BYTE_VOCABULARY, PATTERN, QUERIES, RANKS_FILE, WORD_FILE

FOLDER = "/root/testdata/sf0.001"


def library(file):
    tool = Tokenizer.from_file(file)
    tool.encode_special_tokens = True
    return lambda text: tool.encode(text or "", add_special_tokens=False).ids


def ranked():
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(RANKS_FILE), special_tokens={})
    return lambda text: own.encode_ordinary(text or "")


def texts_of(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_replay_follows_the_plain_rule_even_if_ranks_fall():
    ranks = {bytes([b]): b for b in range(256)}
    # "ab" has a late rank, "abc" an early one: after a merge a lower rank appears.
    for i, token in enumerate([b"aa", b"abc", b"aab", b"bc", b"ab", b"cab", b"aaab"]):
        ranks[token] = 256 + i
    replay = MergeReplay(ranks)
    rng = np.random.default_rng(1)
    words = [bytes(rng.choice([97, 98, 99], rng.integers(0, 30)).tolist()) for _ in range(500)]
    ids, n = replay.encode(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [replay.one_word(w) for w in words]


def test_op4_against_the_library(spark):
    encode, texts = ranked(), texts_of(spark)
    rows = QUERIES["op4_byte_bpe"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids, raw = encode(texts[r.doc_id]), (texts[r.doc_id] or "").encode()
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_encode_and_decode_odd_texts(make_docs, odd_texts):
    encode = ranked()
    docs = make_docs([*odd_texts, "null id"], [*range(len(odd_texts)), None])
    encoded = encode_documents(docs, RANKS_FILE, PATTERN)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {i: encode(t) for i, t in [*enumerate(odd_texts), (None, "null id")]}
    back = {r.doc_id: bytes(r.bytes).decode() for r in decode_documents(encoded, RANKS_FILE, PATTERN).collect()}
    assert back == {i: t or "" for i, t in [*enumerate(odd_texts), (None, "null id")]}
    assert round_trip_digests(make_docs([]), RANKS_FILE, PATTERN).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31])
def test_bit_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 5000):
        ids = rng.integers(0, 1 << bits, n)
        assert token_files.unpack(token_files.pack(ids, bits), bits, n).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        token_files.pack(np.array([1 << bits]), bits)


def check_files(rows, texts, encode):
    """texts: (doc_id, text) in file order."""
    start, want = 0, []
    for i, t in texts:
        ids = [*encode(t), 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda x: x[1]) == want


def test_op6_against_the_library(spark):
    check_files(QUERIES["op6_token_files"](spark, FOLDER).collect(), sorted(texts_of(spark).items()), library(BYTE_FILE))


def test_files_of_odd_texts_and_random_access(make_docs, odd_texts, tmp_path):
    ids = [None, *range(5, 4 + len(odd_texts))]
    encoder = lambda: pieces.byte_encoder(BYTE_FILE, PATTERN)
    manifest = token_files.write_token_files(make_docs(odd_texts, ids), str(tmp_path), encoder, BYTE_VOCABULARY, docs_per_shard=7)
    check_files(token_files.read_token_files(manifest).collect(), list(zip(ids, odd_texts, strict=True)), library(BYTE_FILE))
    assert manifest.count() > 2
    for f in manifest.collect():
        reader = token_files.ShardReader(f.path)
        every = reader.ids(0, reader.n_ids)
        for a, b in ((0, 1), (reader.n_ids - 1, reader.n_ids), (reader.n_ids // 3, reader.n_ids // 2)):
            assert reader.ids(a, b).tolist() == every[a:b].tolist()
    empty = token_files.write_token_files(make_docs([]), str(tmp_path / "none"), encoder, BYTE_VOCABULARY)
    assert token_files.read_token_files(empty).count() == 0


def check_packing(rows, texts, encode, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids = [*encode(t), 0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        cuts = range(0, len(ids), capacity)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [
            (p, a, len(ids[a : a + capacity]), zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes())) for p, a in enumerate(cuts)
        ]
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_op9_against_the_library(spark):
    rows = QUERIES["op9_packing"](spark, FOLDER).collect()
    n = check_packing(rows, texts_of(spark), library(WORD_FILE), 2048)
    assert n <= packing.lower_bound(np.array([r.length for r in rows]), 2048) + 1


def test_packing_of_odd_texts_in_small_groups(make_docs, odd_texts):
    texts = {i: t for i, t in enumerate(odd_texts * 4)}
    docs = make_docs(list(texts.values()))
    for capacity, group in ((64, 20), (100, 20), (7, 1000)):
        rows = packing.pack_documents(docs, lambda: pieces.word_encoder(WORD_FILE), capacity, group_pieces=group).collect()
        n = check_packing(rows, texts, library(WORD_FILE), capacity)
        assert n <= 1.1 * packing.lower_bound(np.array([r.length for r in rows]), capacity) + 2
    assert packing.pack_documents(make_docs([]), lambda: pieces.word_encoder(WORD_FILE)).count() == 0
    repeated = make_docs(["same"] * 9, [None] * 3 + [5] * 6)
    assert packing.pack_documents(repeated, lambda: pieces.word_encoder(WORD_FILE)).count() == 9


def test_lower_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(5)
    for _ in range(60):
        capacity = int(rng.integers(5, 200))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 80)))
        bins, offsets, used = packing.best_fit(lengths, capacity)
        assert packing.lower_bound(lengths, capacity) <= len(used) and used.max() <= capacity
        assert np.bincount(bins, lengths).astype(int).tolist() == used.tolist()
    # 34 pieces just over half need 34 bins though their sum fits 18.
    assert packing.lower_bound(np.full(34, 52), 100) == 34
