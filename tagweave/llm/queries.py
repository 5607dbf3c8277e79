"""Queries of this subpackage: each applies one operator to its whole table; their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import (
    byte_bpe, exact_dedup, exact_search, jaccard, language_model, lexical_search, nearest, packing, pieces, quality, token_alignment, token_files, toxicity, warc,
)
from tagweave.llm.common import fold, new_folder, table

RANKS_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
PATTERN = public_tokenizers.PATTERN
BYTE_VOCABULARY = 50_257


def op1_nearest(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return nearest.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = fold("doc_id", 3) == 1
    model = quality.train_quality(docs.where(~held_out), table(spark, folder, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links")


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.round_trip_digests(table(spark, folder, "documents"), RANKS_FILE, PATTERN)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = fold("doc_id", 4) == 2
    model = toxicity.train_toxicity(docs.where(~held_out), table(spark, folder, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    place = token_files.token_file_folder(docs)
    files = token_files.write_token_files(docs, place, lambda: pieces.byte_encoder(BYTE_FILE, PATTERN), BYTE_VOCABULARY)
    return token_files.read_token_files(files, ids=False)


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return warc.capture_digests(warc.archive_round_trip(pages, new_folder(spark, "archives"), payloads=False))


def op8_language_model(spark: SparkSession, folder: str) -> DataFrame:
    held_out = fold("doc_id", 5) == 1
    scored = language_model.score_documents(table(spark, folder, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), lambda: pieces.word_encoder(WORD_FILE))


def op10_exact_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return exact_search.exact_search(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    encoders = token_alignment.encoder_pair(BYTE_FILE, PATTERN, PIECE_FILE)
    return token_alignment.alignment_counts(table(spark, folder, "documents"), encoders)


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.ranked_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest,
    "op2_quality": op2_quality,
    "op3_jaccard": op3_jaccard,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_token_files": op6_token_files,
    "op7_warc": op7_warc,
    "op8_language_model": op8_language_model,
    "op9_packing": op9_packing,
    "op10_exact_search": op10_exact_search,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_lexical_search": op13_lexical_search,
}

_FINITE = "embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))"

ORACLES: dict[str, str] = {
    "op1_nearest": f"""
        with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
                   where vec_id is not null and {_FINITE} and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
        s as (select q.vec_id as query_id, d.vec_id, list_inner_product(q.e, d.e) as score
              from v q join v d on q.vec_id <> d.vec_id and len(q.e) = len(d.e) where q.vec_id % 20 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
        select query_id, n::int as rank, vec_id, score from r where n <= 20""",
    "op10_exact_search": f"""
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
                   where vec_id is not null and {_FINITE}),
        s as (select q.vec_id as query_id, d.vec_id, list_inner_product(q.e, d.e)::bigint as score
              from v q join v d on q.vec_id <> d.vec_id and len(q.e) = len(d.e) where q.vec_id % 50 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
        select query_id, n::int as rank, vec_id, score from r where n <= 5""",
    "op11_exact_dedup": """
        with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
        g as (select x, max(doc_id) as keep_id, count(*) as group_size from t group by x)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t.x) as text_sha256 from t join g on t.x = g.x""",
    "op13_lexical_search": r"""
        with words as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
        sums as (select count(*) as n_docs, sum(len(t))::bigint as total from words where len(t) > 0),
        tf as (select doc_id, len(t) as n, unnest(t) as term from words),
        counted as (select doc_id, n, term, count(*) as tf from tf group by all),
        df as (select term, count(*) as df from counted group by term),
        asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
        scored as (select item_id, doc_id, sum(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint
                * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total))))::bigint as score
                from asked join counted using (term) join df using (term), sums group by item_id, doc_id),
        ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as r from scored where score > 0)
        select item_id, r::int as rank, doc_id, score from ranked where r <= 10""",
}
