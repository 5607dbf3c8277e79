"""Words built to collide in polynomial hashes, and columns named like the operators' own."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagweave.llm import jaccard, language_model, packing, pieces, token_files
from tagweave.llm.common import new_folder, word_hashes
from tagweave.llm.queries import BYTE_FILE, BYTE_VOCABULARY, PATTERN, WORD_FILE


def thue_morse(bits):
    t = "a"
    for _ in range(bits):
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


TEXTS = [f"x {w}" for bits in (10, 11, 12, 13) for w in thue_morse(bits)]


def test_hashes_differ():
    words = [w.encode() for bits in range(3, 14) for w in thue_morse(bits)] + [b"a" * n for n in range(1, 40)]
    words += [b"ab\0", b"ab", b"ab\0\0", b"abcdefghABCDEFGH", b"ABCDEFGHabcdefgh"]
    assert len(set(word_hashes([b" ".join(words)])[0].tolist())) == len(words)


def test_ids_links_and_counts_of_colliding_words(spark, make_docs):
    docs = make_docs(TEXTS)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for file, rows in (
        (BYTE_FILE, token_files.read_token_files(token_files.write_token_files(docs, new_folder(spark, "collide"), lambda: pieces.byte_encoder(BYTE_FILE, PATTERN), BYTE_VOCABULARY), ids=False)),
        (WORD_FILE, packing.pack_documents(docs, lambda: pieces.word_encoder(WORD_FILE), capacity=1 << 14)),
    ):
        tool = Tokenizer.from_file(file)
        assert {r.doc_id: r.ids_crc32 for r in rows.collect()} == {i: crc([*tool.encode(t, add_special_tokens=False).ids, 0]) for i, t in enumerate(TEXTS)}
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in jaccard.jaccard_classes(docs).collect())
    known = {r.doc_id: r.n_known for r in language_model.score_documents(docs, F.col("doc_id") % 2 == 0).collect()}
    assert known == {i: 3 if i % 2 == 0 else 2 for i in range(len(TEXTS))}


def test_columns_named_like_the_operators_own(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "a"), (2, text + " end", "b"), (3, "other words here in a row", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string").withColumns({c: F.lit(c) for c in ("_text_node", "_NODE", "_rows", "class")})
    kept = jaccard.one_per_class(docs, jaccard.jaccard_classes(docs))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r._key, r._NODE) for r in kept.collect()) == [(1, "a", "_NODE"), (3, "c", "_NODE")]
    own = spark.range(2000).select(F.lit(7).alias("length"), *(F.lit(c).alias(c) for c in ("_group", "_open", "_first", "_spread")))
    packed = packing.pack_pieces(own, 70, group_pieces=200)
    assert packed.columns == [*own.columns, "sequence_id", "offset"]
    sizes = Counter(r.sequence_id for r in packed.collect())
    # Equal pieces do not gather in one group, and still fill nearly every sequence: certified groups keep sequences that are over half full.
    assert len(sizes) <= 202 and sum(sizes.values()) == 2000
    assert len({i >> 28 for i in sizes}) > 5
