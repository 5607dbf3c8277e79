"""Language-model scores: a Bloom filter of quantised n-gram log counts, smoothed by interpolation.

Counts are taken over the whole training part: tasks reduce their words and word pairs to distinct 64-bit hashes with counts,
which are dealt by hash and summed. An n-gram whose count has level q (1 + floor of its logarithm) is put into the
filter q times, once for each level up to q; asking for level 1, 2, ... until one is missing gives the level back.
The filter grows with the n-grams: no count is left out. It is a table by bucket: the levels of frequent n-grams, whose number has a bound, are
sent to the workers, and every chunk of text asks each of its other distinct n-grams once, by bucket. For words the base score gets
their exact counts in the same way; neither ever gathers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import arrow_map, byte_table, mix, segment_sum, stored, text_slices, word_hashes

LEVEL_BASE = 1.5
MAX_LEVEL = 64
PROBES = 4
BITS_PER_ITEM = 10
# N-grams above one in this many training tokens (of their bucket, times the buckets) are sent to the workers: fewer than this many of a kind.
FREQUENT = 1 << 20
# Tokens whose questions go out together.
ASK_TOKENS = 1_000_000
WORD_BUCKET_BYTES, PAIR_BUCKET_BYTES = 16 << 20, 8 << 20
# Distinct n-grams that a counting task holds before it reduces them.
HELD = 1_000_000
RATIO_BINS = 96
# Mark of a token whose level is asked for; levels are below it.
ASKED = 255

_TABLE = byte_table(b" \t\n\v\f\r", lower=True)
_END = np.uint64(0x7C15E2F0A5D3B911)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_LEVEL = 0xA0761D6478BD642F
WORD, PAIR, OWN = 0, 1, 2
KEY_BITS = (64, 48)


def sequence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, each text's words and then one end; tokens per text."""
    words, n = word_hashes([t.encode("utf-8", "surrogatepass").translate(_TABLE) for t in texts])
    return np.insert(words, np.cumsum(n), _END), n + 1


def pair_keys(tokens: np.ndarray) -> np.ndarray:
    """48-bit keys of each token with the one before it; what stands before a text's first word is an end."""
    before = np.concatenate((np.full(1, _END), tokens[:-1]))
    return mix(before * _PAIR + tokens) >> np.uint64(64 - KEY_BITS[PAIR])


def level(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log count), 0 for no count."""
    out = np.zeros(len(counts), np.int64)
    seen = counts > 0
    out[seen] = 1 + np.floor(np.log(counts[seen]) / np.log(LEVEL_BASE) + 1e-9).astype(np.int64)
    return np.minimum(out, MAX_LEVEL - 1)


def reduced(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, summed counts)."""
    if not len(keys):
        return keys.astype(np.uint64), np.empty(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sums = np.diff(np.append(at, len(keys))) if counts is None else np.add.reduceat(counts, at)
    return keys[at], sums


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers, all lowest bytes first, in as many bytes each as the largest takes: small ones compress well."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Rising keys as gaps."""
    return pack_numbers(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data), dtype=np.uint64)


def pack_places(at: np.ndarray, n: int) -> bytes:
    """Numbers below ``n`` in any order, each in the fewest bits that hold ``n``."""
    bits = np.unpackbits(at.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, : max(1, int(n).bit_length())]
    return np.packbits(bits).tobytes()


def unpack_places(data: bytes, size: int, n: int) -> np.ndarray:
    width = max(1, int(n).bit_length())
    out = np.zeros((size, 32), np.uint8)
    out[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8), count=size * width).reshape(size, width)
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel().astype(np.int64)


def halves(keys: np.ndarray, at_level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit hashes of (key, level); probe i looks at bit low + i * high, modulo the segment's size."""
    y = mix(keys + np.uint64((at_level * _LEVEL) & 0xFFFFFFFFFFFFFFFF))
    return y & np.uint64(0xFFFFFFFF), (y >> np.uint64(32)) | np.uint64(1)


def segment(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, int]:
    """(bits of one bucket's part of the filter, number of bits), sized by what is in it."""
    levels = level(counts)
    size = -(-int(levels.sum()) * BITS_PER_ITEM // 8) * 8
    flags = np.zeros(size, np.uint8)
    for j in range(1, int(levels.max(initial=0)) + 1):
        low, high = halves(keys[levels >= j], j)
        for i in range(PROBES):
            flags[((low + np.uint64(i) * high) % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes(), size


class CountFilter:
    """The filter of one bucket."""

    def __init__(self, bits: bytes, size: int):
        self.bits, self.size = np.frombuffer(bits, np.uint8), np.uint64(size)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key: levels are probed upwards until one is missing."""
        out = np.zeros(len(keys), np.int64)
        open_, keys_ = np.arange(len(keys) if len(self.bits) else 0), keys
        for j in range(1, MAX_LEVEL):
            if not len(open_):
                break
            found, left = np.ones(len(open_), bool), np.arange(len(open_))
            low, high = halves(keys_, j)
            for i in range(PROBES):
                bit = ((low[left] + np.uint64(i) * high[left]) % self.size).astype(np.int64)
                hit = (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
                found[left[hit == 0]] = False
                left = left[hit == 1]
            open_, keys_ = open_[found], keys_[found]
            out[open_] = j
        return out


class Smoothing:
    """What levels stand for: mean counts and probabilities of tokens from the levels of words and pairs in order."""

    def __init__(self, means: dict[int, np.ndarray], n_tokens: int, n_words: int):
        self.means, self.n_tokens, self.n_words = means, n_tokens, n_words

    def features(self, words: np.ndarray, pairs: np.ndarray, first_end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per token: level of the token before it, that level's mean count, the pair's mean count, the token's own probability.

        What stands before the first token is an end, as at place ``first_end``.
        """
        before = np.concatenate((words[first_end : first_end + 1], words[:-1]))
        word = (self.means[WORD][words] + 0.5) / (self.n_tokens + 0.5 * (self.n_words + 1))
        return before, self.means[WORD][before], self.means[PAIR][pairs], word

    def log10(self, words: np.ndarray, pairs: np.ndarray, first_end: int, weights: np.ndarray) -> np.ndarray:
        """log10 probabilities: weight x pair share + (1 - weight) x word probability, the weight by the level of the word before."""
        before, context, pair, word = self.features(words, pairs, first_end)
        share = np.minimum(1.0, np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0))
        w = np.where(context > 0, weights[before], 0.0)
        return np.log10(w * share + (1 - w) * word)


def n_buckets(total_bytes: int, per_bucket: int) -> int:
    return 1 << max(2, (max(1, total_bytes // per_bucket) - 1).bit_length())


def ngram_counts(docs: DataFrame, text: str, buckets: tuple[int, int]) -> DataFrame:
    """One row per kind and bucket: distinct n-grams, tokens, n-grams and tokens by level, filter segment, frequent ones, and for words all counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for _, texts in text_slices(batches, text):
            tokens, _ = sequence(texts)
            for kind, keys in ((WORD, tokens), (PAIR, pair_keys(tokens))):
                held[kind].append(reduced(keys))
                if sum(len(k) for k, _ in held[kind]) > 2 * HELD:
                    held[kind][:] = [reduced(np.concatenate([k for k, _ in held[kind]]), np.concatenate([n for _, n in held[kind]]))]
                    if len(held[kind][0][0]) > HELD:
                        yield from out(kind, *held[kind].pop())
        for kind in (WORD, PAIR):
            if held[kind]:
                yield from out(kind, *reduced(np.concatenate([k for k, _ in held[kind]]), np.concatenate([n for _, n in held[kind]])))

    def out(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, bits = buckets[kind], KEY_BITS[kind]
        cuts = np.searchsorted(keys >> np.uint64(bits - n.bit_length() + 1), np.arange(n + 1, dtype=np.uint64))
        rows = [(b, i, j) for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if i < j]
        columns = [
            pa.array([kind] * len(rows), pa.int32()), pa.array([b for b, _, _ in rows], pa.int32()),
            pa.array([pack_keys(keys[i:j]) for _, i, j in rows], pa.binary()),
            pa.array([pack_numbers(counts[i:j]) for _, i, j in rows], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "bucket", "keys", "counts"])

    def total(rows: pa.Table) -> pa.Table:
        kind, bucket = rows.column("kind")[0].as_py(), rows.column("bucket")[0].as_py()
        keys = np.concatenate([unpack_keys(x) for x in rows.column("keys").to_pylist()])
        counts = np.concatenate([unpack_numbers(x) for x in rows.column("counts").to_pylist()]).astype(np.int64)
        keys, counts = reduced(keys, counts)
        levels = level(counts)
        bits, size = segment(keys, counts)
        top = counts * FREQUENT > counts.sum() * buckets[kind]
        row = {
            "kind": kind, "bucket": bucket, "distinct": len(keys), "tokens": int(counts.sum()),
            "by_level": np.bincount(levels, minlength=MAX_LEVEL).tolist(), "tokens_by_level": np.bincount(levels, counts, MAX_LEVEL).astype(np.int64).tolist(),
            "bits": bits, "size": size, "top_keys": keys[top].tobytes(), "top_counts": counts[top].tobytes(),
            "top_levels": CountFilter(bits, size).levels(keys[top]).astype(np.uint8).tobytes(),
            "keys": pack_keys(keys) if kind == WORD else None, "counts": pack_numbers(counts) if kind == WORD else None,
        }
        return pa.Table.from_pylist([row], schema=schema)

    long = pa.int64()
    schema = pa.schema([
        ("kind", pa.int32()), ("bucket", pa.int32()), ("distinct", long), ("tokens", long), ("by_level", pa.list_(long)),
        ("tokens_by_level", pa.list_(long)), ("bits", pa.binary()), ("size", long), ("top_keys", pa.binary()), ("top_counts", pa.binary()),
        ("top_levels", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()),
    ])
    counted = arrow_map(docs.select(text), count, "kind int, bucket int, keys binary, counts binary")
    return counted.groupBy("kind", "bucket").applyInArrow(
        total,
        "kind int, bucket int, distinct long, tokens long, by_level array<long>, tokens_by_level array<long>, bits binary, size long, "
        "top_keys binary, top_counts binary, top_levels binary, keys binary, counts binary",
    )


def smoothing(table: DataFrame) -> Smoothing:
    """A few sums over all n-grams."""
    sums = {r.kind: r for r in table.groupBy("kind").agg(F.sum("distinct").alias("n"), F.sum("tokens").alias("t")).collect()}
    by_level = table.select("kind", F.posexplode(F.arrays_zip("by_level", "tokens_by_level")).alias("level", "x"))
    by_level = by_level.groupBy("kind", "level").agg(F.sum("x.by_level").alias("n"), F.sum("x.tokens_by_level").alias("t")).collect()
    means = {k: np.zeros(MAX_LEVEL) for k in (WORD, PAIR)}
    for r in by_level:
        means[r.kind][r.level] = r.t / r.n if r.n else 0.0
    for m in means.values():
        # A level that no n-gram has can still be met by a chance hit: the level's own lowest count stands for it.
        m[1:] = np.where(m[1:] > 0, m[1:], LEVEL_BASE ** np.arange(MAX_LEVEL - 1))
    words = sums.get(WORD)
    return Smoothing(means, words.t if words else 0, words.n if words else 0)


def frequent_ngrams(table: DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys in order, counts, levels by the filter) of the frequent n-grams."""
    rows = table.where(F.col("kind") == kind).select("top_keys", "top_counts", "top_levels").collect()
    keys, counts, levels = (np.frombuffer(b"".join(bytes(r[i]) for r in rows), t) for i, t in enumerate((np.uint64, np.int64, np.uint8)))
    order = np.argsort(keys)
    return keys[order], counts[order], levels[order]


def chunk_levels(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens per text, levels of words, levels of pairs) of one row of stored levels."""
    return np.array(row["n"], np.int64), *(np.frombuffer(row[c], np.uint8).astype(np.int64) for c in ("words", "pairs"))


def fit_weights(chunks: DataFrame, model: Smoothing) -> np.ndarray:
    """Weight of the pair share for each level of the word before, by deleted interpolation over all training tokens.

    Each token's pair share is taken without the token itself. Tasks reduce the ratios of that share to the word's own probability to a
    histogram; a few rounds of expectation maximisation on the summed histogram give the most likely weight.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((MAX_LEVEL, RATIO_BINS), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                n, words, pairs = chunk_levels(row)
                learnt = np.repeat(np.array(row["train"], bool), n)
                before, context, pair, word = model.features(words, pairs, n[0] - 1)
                share = np.clip(np.divide(pair - 1, context - 1, out=np.zeros(len(pair)), where=context > 1), 0, 1)
                ratio = share / word
                bins = np.zeros(len(ratio), np.int64)
                up = ratio > 0
                bins[up] = np.clip(np.rint(2 * np.log2(ratio[up])) + RATIO_BINS // 3, 1, RATIO_BINS - 1)
                total += np.bincount((before * RATIO_BINS + bins)[learnt], minlength=total.size).reshape(total.shape)
        level_, bin_ = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (level_, bin_, total[level_, bin_])], ["level", "bin", "n"])

    rows = arrow_map(chunks.select("train", "n", "words", "pairs"), run, "level long, bin long, n long").groupBy("level", "bin").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros((MAX_LEVEL, RATIO_BINS))
    for r in rows:
        seen[r.level, r.bin] = r.n
    ratio = 2.0 ** ((np.arange(RATIO_BINS) - RATIO_BINS // 3) / 2)
    ratio[0] = 0.0
    weights = np.full(MAX_LEVEL, 0.3)
    for _ in range(100):
        part = weights[:, None] * ratio
        weights = (seen * part / (part + 1 - weights[:, None])).sum(1) / np.maximum(seen.sum(1), 1)
        # Never all on the pair: an unseen pair keeps a probability.
        weights = np.minimum(weights, 0.999)
    return weights


def score_documents(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, n_known, train_tokens, base_score and score of its whole text, learnt from the rows where ``training`` holds.

    Tokens are the words between the white space of ASCII, with A-Z lower-cased, and one end. ``base_score`` is the log10 probability under
    exact word counts with 0.5 added to each, ``score`` under the interpolated pairs of the filter. Null texts count as empty, as
    one end; repeated rows count as often as they occur; null keys stay; a table without training rows gives every token the one
    probability of an unknown word; an empty table gives an empty one. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text), F.coalesce(training, F.lit(False)).alias("_train"))
    learn = rows.where("_train").select(text)
    total_bytes = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = n_buckets(total_bytes, WORD_BUCKET_BYTES), n_buckets(total_bytes, PAIR_BUCKET_BYTES)
    counts = stored(ngram_counts(learn, text, buckets), "ngrams")
    model = smoothing(counts)
    # Arrays alone, of fewer than FREQUENT n-grams of a kind.
    sent = spark.sparkContext.broadcast({k: frequent_ngrams(counts, k) for k in (WORD, PAIR)})
    n_tokens, n_words = model.n_tokens, model.n_words

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per some slices: one row of what is known about their texts, and for each bucket one with the rarer distinct n-grams."""
        part, k, held, n_held = TaskContext.get().partitionId(), 0, [], 0
        for batch, texts in text_slices(batches, text):
            held.append((batch.column(key).to_pylist(), batch.column("_train").to_pylist(), *sequence(texts)))
            n_held += len(held[-1][2])
            if n_held >= ASK_TOKENS:
                yield asked_of(part << 32 | k, held)
                k, held, n_held = k + 1, [], 0
        if held:
            yield asked_of(part << 32 | k, held)

    def asked_of(chunk: int, held: list[tuple]) -> pa.RecordBatch:
        tokens, n = (np.concatenate([h[i] for h in held]) for i in (2, 3))
        own = {"chunk": chunk, "kind": OWN, "bucket": chunk, "n": n.tolist(), "ids": [x for h in held for x in h[0]], "train": [x for h in held for x in h[1]]}
        out = [own]
        for kind, name, keys in ((WORD, "words", tokens), (PAIR, "pairs", pair_keys(tokens))):
            known, known_counts, known_levels = sent.value[kind]
            at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            levels = np.zeros(len(keys), np.uint8)
            # What is not among the frequent ones is marked, and stands in the order of the text as a place among the distinct rarer keys.
            levels[~hit], levels[hit] = ASKED, known_levels[at[hit]]
            if kind == WORD:
                log = np.zeros(len(keys))
                log[hit] = np.log10(known_counts[at[hit]] + 0.5)
                own["base"], own["known"] = segment_sum(log, n).tolist(), segment_sum(hit.astype(np.int64), n).tolist()
            rare, place = np.unique(keys[~hit], return_inverse=True)
            own[name], own[f"{name}_at"] = levels.tobytes(), pack_places(place, len(rare))
            cuts = np.searchsorted(rare >> np.uint64(KEY_BITS[kind] - buckets[kind].bit_length() + 1), np.arange(buckets[kind] + 1, dtype=np.uint64)).tolist()
            for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if i < j:
                    out.append({"chunk": chunk, "kind": kind, "bucket": b, "keys": pack_keys(rare[i:j])})
        return pa.RecordBatch.from_pylist(out, schema=asked)

    def answer(questions: pa.Table, ngrams: pa.Table) -> pa.Table:
        """Levels of a bucket's n-grams, and counts of words, in the order in which they were asked for; rows about whole chunks pass."""
        if not questions.num_rows or questions.column("kind")[0].as_py() == OWN:
            return questions.select(asked.names).cast(asked)
        kind, out = questions.column("kind")[0].as_py(), []
        segment_, keys, counts = None, np.empty(0, np.uint64), np.empty(0, np.uint64)
        if ngrams.num_rows:
            row = ngrams.to_pylist()[0]
            segment_ = CountFilter(row["bits"], row["size"])
            if kind == WORD:
                keys, counts = unpack_keys(row["keys"]), unpack_numbers(row["counts"])
        for row in questions.select(["chunk", "kind", "bucket", "keys"]).to_pylist():
            wanted = unpack_keys(row.pop("keys"))
            levels = segment_.levels(wanted) if segment_ else np.zeros(len(wanted), np.int64)
            if kind == WORD:
                at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
                row["counts"] = pack_numbers(np.where(keys[at] == wanted, counts[at], 0) if len(keys) else np.zeros(len(wanted), np.uint64))
            out.append({**row, "words": levels.astype(np.uint8).tobytes()})
        return pa.Table.from_pylist(out, schema=asked)

    def gather(rows: pa.Table) -> pa.Table:
        """A chunk's texts with the levels of all their tokens and the base score."""
        parts = sorted(rows.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
        own = next(r for r in parts if r["kind"] == OWN)
        n = np.array(own["n"], np.int64)
        log, known = np.zeros(int(n.sum())), np.zeros(int(n.sum()), np.int64)
        for kind, name in ((WORD, "words"), (PAIR, "pairs")):
            found = [r for r in parts if r["kind"] == kind]
            levels = np.frombuffer(own[name], np.uint8).copy()
            at = np.flatnonzero(levels == ASKED)
            rare = np.frombuffer(b"".join(r["words"] for r in found), np.uint8)
            place = unpack_places(own[f"{name}_at"], len(at), len(rare))
            if len(at):
                levels[at] = rare[place]
                if kind == WORD:
                    counts = np.concatenate([unpack_numbers(r["counts"]) for r in found]).astype(np.int64)[place]
                    log[at], known[at] = np.log10(counts + 0.5), counts > 0
            own[name] = levels.tobytes()
        base = np.array(own["base"]) + segment_sum(log, n) - n * np.log10(n_tokens + 0.5 * (n_words + 1))
        known = np.array(own["known"], np.int64) + segment_sum(known, n)
        row = {**{c: own[c] for c in ("ids", "train", "n", "words", "pairs")}, "known": known.tolist(), "base": base.tolist()}
        return pa.Table.from_pylist([row], schema=levelled)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                n, words, pairs = chunk_levels(row)
                sums = segment_sum(model.log10(words, pairs, n[0] - 1, weights), n)
                columns = [pa.array(row["ids"], long), pa.array(n), pa.array(row["known"], long), pa.array(np.full(len(n), n_tokens)), pa.array(row["base"], double), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    long, double, binary = pa.int64(), pa.float64(), pa.binary()
    whole = [("ids", pa.list_(long)), ("train", pa.list_(pa.bool_())), ("n", pa.list_(long)), ("known", pa.list_(long)), ("base", pa.list_(double)), ("words", binary), ("pairs", binary)]
    asked = pa.schema([("chunk", long), ("kind", pa.int32()), ("bucket", long), ("keys", binary), ("counts", binary), ("words_at", binary), ("pairs_at", binary), *whole])
    levelled = pa.schema(whole)
    kinds = "ids array<long>, train array<boolean>, n array<long>, known array<long>, base array<double>, words binary, pairs binary"
    asked_kinds = f"chunk long, kind int, bucket long, keys binary, counts binary, words_at binary, pairs_at binary, {kinds}"
    questions = arrow_map(rows, ask, asked_kinds)
    ngrams = counts.select("kind", F.col("bucket").cast("long").alias("bucket"), "keys", "counts", "bits", "size")
    answers = questions.groupBy("kind", "bucket").cogroup(ngrams.groupBy("kind", "bucket")).applyInArrow(answer, asked_kinds)
    # A bucket without questions brings no row; a chunk's own row is always there.
    chunks = stored(answers.groupBy("chunk").applyInArrow(gather, kinds), "levels")
    weights = fit_weights(chunks, model)
    return arrow_map(chunks, score, f"{key} long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
