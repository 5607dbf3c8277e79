"""Alignment of two tokenizers' tokens of the same text: lockstep merging of all documents of a batch in numpy.

Both token sequences cover the same bytes, so both are lists of rising end offsets. One state vector holds a pointer into A and one into B for
every document of the batch, of long documents one for each of several lanes that start where both sides are known to end. A step links the tokens
under all pointers, cuts where both end, and moves on the side that ends first, or both; finished documents leave the vector.
How often two ids are linked in the whole corpus is counted by bucket of the id pair: each stretch of text brings its distinct
pairs, sums are taken over bounded numbers of stretches and then over all, and every stretch gets its pairs' counts back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import arrow_map, kept_in_worker, mix, ranges, segment_sum, stored, text_slices
from tagweave.llm.pieces import LibraryEncoder, PieceEncoder, byte_letters

# Text that is aligned at once, and text whose distinct pairs ask together.
BATCH_CHARS, STRETCH_CHARS = 2_000_000, 12_000_000
# Tokens of A in a lane, and how far behind a lane's end a common cut is looked for.
LANE, REACH = 512, 32
# Buckets of id pairs; vocabularies bound what is in one. Stretches whose pairs meet in one task.
BUCKETS, STRETCHES = 64, 256


class ExactBytes:
    """A tokenizer whose ids are checked piece by piece against the bytes they stand for; -1 marks a piece that they do not give back."""

    def _token_bytes(self) -> list[bytes]:
        raise NotImplementedError

    def tokens(self) -> list[bytes]:
        if not hasattr(self, "_tokens"):
            self._tokens = self._token_bytes()
        return self._tokens

    def encode_pieces(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, size = super().encode_pieces(pieces)
        tokens, ids, out, sizes, at = self.tokens(), flat.tolist(), [], size.copy(), 0
        for k, (piece, n) in enumerate(zip(pieces, size.tolist(), strict=True)):
            own = ids[at : at + n]
            at += n
            if -1 in own or b"".join([tokens[i] for i in own]) != piece:
                own, sizes[k] = [-1], 1
            out += own
        return np.array(out, np.int32), sizes


class SpacedLibraryEncoder(ExactBytes, LibraryEncoder):
    """A byte-level vocabulary of the tokenizers library."""

    def _token_bytes(self) -> list[bytes]:
        byte = {c: b for b, c in enumerate(byte_letters())}
        out = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        return out


class SentencePieceIds(PieceEncoder):
    """A sentencepiece model that writes a space in front. Texts are given with that space, ids are those of the text behind it."""

    def __init__(self, file: str):
        from sentencepiece import SentencePieceProcessor

        super().__init__()
        self.model = SentencePieceProcessor(model_file=file)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self._space = self.model.piece_to_id("▁")
        # Pieces between spaces or line breaks are independent only if no token reaches across.
        self._apart = not any("▁" in p.lstrip("▁") or "\n" in p for p in self.pieces)

    def _pieces(self, text: str) -> bytes | None:
        return super()._pieces(text) if self._apart else None

    def encode_whole(self, text: str) -> Sequence[int]:
        return self.model.encode(text[1:], num_threads=1)

    def encode_pieces(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = self.model.encode([p.decode("utf-8", "surrogatepass").removeprefix(" ") for p in pieces], num_threads=1)
        # A line break has no space in front of it in the text.
        got = [ids if p[:1] == b" " else ids[1:] if ids and ids[0] == self._space else [-1] for p, ids in zip(pieces, got, strict=True)]
        return np.array([i for ids in got for i in ids], np.int32), np.fromiter(map(len, got), np.int64, len(got))


class SentencePieceEncoder(ExactBytes, SentencePieceIds):
    def _token_bytes(self) -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)]


def byte_level(file: str, pattern: str) -> SpacedLibraryEncoder:
    return kept_in_worker(("aligned bytes", file, pattern), lambda: SpacedLibraryEncoder(file, pattern, True))


def sentence_pieces(file: str) -> SentencePieceEncoder:
    return kept_in_worker(("aligned pieces", file), lambda: SentencePieceEncoder(file))


def encoder_pair(byte_file: str, pattern: str, piece_file: str) -> Callable[[], tuple[ExactBytes, ExactBytes]]:
    """What makes both encoders inside a worker."""
    return lambda: (byte_level(byte_file, pattern), sentence_pieces(piece_file))


@dataclass
class Aligned:
    """A batch: ids of both sides, tokens per document, and by place in the ids the links (in no order) and the cuts (in order)."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def lanes(end_a: np.ndarray, end_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token of A, first token of B, token of A to stop before) of every lane: each document with tokens from its start, long ones also
    from the first common cut behind every ``lane`` tokens, where one lies within reach."""
    full = n_a > 0
    first_a, first_b = (np.cumsum(n_a) - n_a)[full], (np.cumsum(n_b) - n_b)[full]
    last = first_a + n_a[full]
    more = np.maximum(0, (n_a[full] - 1) // lane)
    seek = np.repeat(first_a, more) + lane * (ranges(more) + 1)
    stop = np.repeat(last, more)
    place = np.minimum(seek[:, None] + np.arange(REACH), stop[:, None] - 1)
    at = np.searchsorted(end_b, end_a[place])
    # A cut behind the last token starts nothing.
    common = (end_b[np.minimum(at, len(end_b) - 1)] == end_a[place]) & (place < stop[:, None] - 1) if len(place) else np.zeros((0, REACH), bool)
    hit = common.any(1)
    which = common.argmax(1)[hit]
    rows = np.flatnonzero(hit)
    start_a, start_b = place[rows, which] + 1, at[rows, which] + 1
    all_a, all_b = np.concatenate((first_a, start_a)), np.concatenate((first_b, start_b))
    order = np.argsort(all_a, kind="stable")
    all_a, all_b = all_a[order], all_b[order]
    # The same cut may be found twice.
    new = np.concatenate((np.ones(min(1, len(all_a)), bool), all_a[1:] != all_a[:-1]))
    all_a, all_b = all_a[new], all_b[new]
    return all_a, all_b, np.append(all_a[1:], last[-1:])


def lockstep(end_a: np.ndarray, end_b: np.ndarray, starts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A and B of all links, A and B of all cuts) of lanes whose ends rise over the whole batch."""
    i, j, stop = starts
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(i):
        links_a.append(i)
        links_b.append(j)
        a, b = end_a[i], end_b[j]
        on_a, on_b = a <= b, b <= a
        both = on_a & on_b
        cuts_a.append(i[both])
        cuts_b.append(j[both])
        i, j = i + on_a, j + on_b
        left = i < stop
        if not left.all():
            i, j, stop = i[left], j[left], stop[left]
    none = [np.empty(0, np.int64)]
    link_a, link_b, cut_a, cut_b = (np.concatenate(x or none) for x in (links_a, links_b, cuts_a, cuts_b))
    return link_a, link_b, np.sort(cut_a), np.sort(cut_b)


def _ids(encoder: ExactBytes, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ids per text, whether they give the text's bytes back)."""
    ids, n = encoder.encode(texts)
    good = segment_sum((ids < 0).astype(np.int64), n) == 0
    tokens = encoder.tokens()
    # Texts that were encoded whole, or hold a piece that does not come back, are compared whole.
    doubtful = [i for i, t in enumerate(texts) if not good[i] or encoder._pieces(t) is None]
    if doubtful:
        parts = np.split(ids, np.cumsum(n)[:-1])
        for i in doubtful:
            own = np.asarray(encoder.encode_whole(texts[i]), np.int32)
            good[i] = b"".join([tokens[x] for x in own.tolist()]) == texts[i].encode("utf-8", "surrogatepass")
            parts[i] = own
            n[i] = len(own)
        ids = np.concatenate(parts)
    return ids, n, good


def align(texts: list[str], encoder_a: ExactBytes, encoder_b: ExactBytes, lane: int = LANE) -> Aligned:
    """Tokens, links and cuts of a batch. Empty texts, and those whose bytes one side does not give back, have no tokens."""
    spaced = [" " + t for t in texts]
    (a, n_a, good_a), (b, n_b, good_b) = _ids(encoder_a, spaced), _ids(encoder_b, spaced)
    good = good_a & good_b & np.fromiter((t != "" for t in texts), bool, len(texts))
    a, b, n_a, n_b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], np.where(good, n_a, 0), np.where(good, n_b, 0)
    # Both sides have the same bytes, so their ends are offsets on one axis over all documents.
    end_a, end_b = (np.cumsum(sizes(e)[x]) for e, x in ((encoder_a, a), (encoder_b, b)))
    return Aligned(a, b, n_a, n_b, *lockstep(end_a, end_b, lanes(end_a, end_b, n_a, n_b, lane)))


def sizes(encoder: ExactBytes) -> np.ndarray:
    if not hasattr(encoder, "_sizes"):
        encoder._sizes = np.fromiter(map(len, encoder.tokens()), np.int64, len(encoder.tokens()))
    return encoder._sizes


def group_digests(x: Aligned, shown: tuple[list[bytes], list[bytes]]) -> list[str]:
    """SHA-256 of each document's groups as ``a1,a2|b1;a3|b2,b3``; '' without tokens. ``shown`` has each id with a comma and with its group's end."""
    last_a, last_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
    last_a[x.cut_a], last_b[x.cut_b] = 1, 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    # In the written order, tokens of A stand behind all of B in earlier groups, those of B behind all of A up to their own group.
    code = np.empty(len(x.a) + len(x.b), np.int64)
    code[np.arange(len(x.a)) + np.concatenate(([0], x.cut_b + 1))[group_a]] = 2 * x.a.astype(np.int64) + last_a
    code[np.arange(len(x.b)) + (x.cut_a + 1)[group_b]] = len(shown[0]) + 2 * x.b.astype(np.int64) + last_b
    table = shown[0] + shown[1]
    ends, out, at = np.cumsum(x.n_a + x.n_b).tolist(), [], 0
    for end in ends:
        out.append(hashlib.sha256(b"".join([table[c] for c in code[at:end].tolist()])[:-1]).hexdigest() if end > at else "")
        at = end
    return out


def _shown(n: int, end: bytes) -> list[bytes]:
    return [b"%d%b" % (i, e) for i in range(n) for e in (b",", end)]


def pack(numbers: np.ndarray) -> bytes:
    """Numbers of any size, all lowest bytes first, in as many bytes each as the largest takes: small ones compress well."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, summed counts)."""
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys, kind="stable")
    all_keys, all_counts = all_keys[order], all_counts[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(all_keys)), bool), all_keys[1:] != all_keys[:-1])))
    return all_keys[at], np.add.reduceat(all_counts, at) if len(at) else all_counts


_STRETCH = "n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, cells binary, times binary"
_ASKED = "keys binary, counts binary"


def aligned_stretches(docs: DataFrame, encoders: Callable[[], tuple[ExactBytes, ExactBytes]], key: str, text: str, stretch_chars: int) -> DataFrame:
    """Per stretch of documents one row (bucket -1) with their numbers, and one per bucket with the distinct id pairs that are linked in it.

    ``cells`` are the gaps between document x (number of the stretch's pairs) + pair, ``times`` how often the document links the pair.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["stretch", "bucket", "keys", "counts", "ids", "n_a", "n_b", "n_groups", "n_links", "groups", "cells", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = encoders()
        shown = kept_in_worker(("shown ids", len(a.tokens()), len(b.tokens())), lambda: (_shown(len(a.tokens()), b"|"), _shown(len(b.tokens()), b";")))
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        for rows, texts in text_slices(batches, text, BATCH_CHARS):
            x = align(texts, a, b)
            doc_a = np.repeat(np.arange(len(texts)), x.n_a)
            doc = doc_a[x.link_a]
            pair, which = np.unique(x.a[x.link_a].astype(np.int64) << 32 | x.b[x.link_b], return_inverse=True)
            cell, times = np.unique(doc * max(1, len(pair)) + which, return_counts=True)
            n_groups, n_links = np.bincount(doc_a[x.cut_a], minlength=len(texts)), np.bincount(doc, minlength=len(texts))
            held.append((rows.column(key), x.n_a, x.n_b, n_groups, n_links, group_digests(x, shown), pair, cell // max(1, len(pair)), cell % max(1, len(pair)), times))
            size += sum(map(len, texts))
            if size >= stretch_chars:
                yield out(part << 32 | k, held)
                k, held, size = k + 1, [], 0
        if held:
            yield out(part << 32 | k, held)

    def out(stretch: int, held: list[tuple]) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate([h[6] for h in held]))
        counts = np.zeros(len(pairs), np.int64)
        cells, base = [], 0
        for h in held:
            place = np.searchsorted(pairs, h[6])[h[8]]
            cells.append((base + h[7]) * len(pairs) + place)
            np.add.at(counts, place, h[9])
            base += len(h[0])
        # Places in the merged list rise as those in the slices do, so the cells are in order.
        cells, times = np.concatenate(cells), np.concatenate([h[9] for h in held])
        bucket = (mix(pairs.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        asked = [(c, order[i:j]) for c, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if i < j]
        n = len(asked)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(values)], pa.int32()), values)
        joined = [np.concatenate([h[c] for h in held]) for c in (1, 2, 3, 4)]
        columns = [
            pa.array([stretch] * (n + 1), pa.int64()), pa.array([c for c, _ in asked] + [-1], pa.int32()),
            pa.array([pack(np.diff(pairs[at], prepend=0)) for _, at in asked] + [None], pa.binary()), pa.array([pack(counts[at]) for _, at in asked] + [None], pa.binary()),
            one(pa.concat_arrays([h[0] for h in held])), *(one(pa.array(c, pa.int64())) for c in joined), one(pa.array([g for h in held for g in h[5]], pa.string())),
            pa.array([None] * n + [pack(np.diff(cells, prepend=0))], pa.binary()), pa.array([None] * n + [pack(times)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(docs.select(key, text), run, f"stretch long, bucket int, {_ASKED}, ids array<{kind}>, {_STRETCH}")


def _read(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.cumsum(unpack(x)) for x in table.column("keys").to_pylist()], [unpack(x) for x in table.column("counts").to_pylist()]


def alignment_counts(
    docs: DataFrame, encoders: Callable[[], tuple[ExactBytes, ExactBytes]], key: str = "doc_id", text: str = "text", stretch_chars: int = STRETCH_CHARS,
    stretches: int = STRETCHES,
) -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, as the module says.

    ``n_best`` counts a document's links whose id pair is linked, over all documents, as often as any pair of its B id; ``count_sum`` adds up the
    pairs' corpus-wide counts over the links. Texts that are null or empty, or that one tokenizer does not give back byte for byte with a space in
    front, have no tokens: zeros and ''. Repeated rows count as often as they occur, null keys stay, other columns are ignored; an empty table
    gives an empty one. ``stretch_chars`` and ``stretches`` decide the way only.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))
    rows = stored(aligned_stretches(docs, encoders, key, text, stretch_chars), "aligned")
    own, asked = rows.where("bucket < 0").drop("keys", "counts", "bucket"), rows.where("bucket >= 0").select("stretch", "bucket", "keys", "counts")
    n_salts = max(1, -(-own.count() // stretches))
    salted = asked.withColumn("salt", F.pmod(F.xxhash64("stretch"), F.lit(n_salts)).cast("int"))

    def total(table: pa.Table) -> pa.Table:
        keys, counts = summed(*_read(table))
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "keys": [pack(np.diff(keys, prepend=0))], "counts": [pack(counts)]})

    def answer(questions: pa.Table, known: pa.Table) -> pa.Table:
        """The questions' pairs with their counts in the whole corpus."""
        if not questions.num_rows:
            return questions.select(["stretch", "keys", "counts"])
        (keys,), (counts,) = _read(known)
        found = [pack(counts[np.searchsorted(keys, k)]) for k in _read(questions)[0]]
        return pa.table({"stretch": questions.column("stretch"), "keys": questions.column("keys"), "counts": pa.array(found, pa.binary())})

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = (np.concatenate(c or [np.empty(0, np.int64)]) for c in _read(pa.Table.from_batches([batch])))
            b = keys & 0xFFFFFFFF
            order = np.lexsort((counts, b))
            last = np.flatnonzero(np.append(b[order][1:] != b[order][:-1], True)) if len(order) else order
            yield pa.RecordBatch.from_arrays([pa.array(b[order][last], pa.int64()), pa.array(counts[order][last], pa.int64())], ["b", "n"])

    summed_once = salted.groupBy("bucket", "salt").applyInArrow(total, f"bucket int, {_ASKED}")
    totals = stored(summed_once.groupBy("bucket").applyInArrow(total, f"bucket int, {_ASKED}"), "pair-counts")
    # One number per id of B: the vocabulary bounds what is sent.
    highest = arrow_map(totals.select("keys", "counts"), most, "b long, n long").groupBy("b").agg(F.max("n").alias("n")).toArrow()
    best = np.zeros(int(highest.column("b").to_numpy().max(initial=-1)) + 1, np.int64)
    best[highest.column("b").to_numpy()] = highest.column("n").to_numpy()
    sent = spark.sparkContext.broadcast(best)
    copies = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))))
    answers = salted.groupBy("bucket", "salt").cogroup(copies.groupBy("bucket", "salt")).applyInArrow(answer, f"stretch long, {_ASKED}")

    def gather(mine: pa.Table, counted: pa.Table) -> pa.Table:
        row = mine.to_pylist()[0]
        keys, counts = summed(*_read(counted)) if counted.num_rows else (np.empty(0, np.int64),) * 2
        n, cells, times = len(row["ids"]), np.cumsum(unpack(row["cells"])), unpack(row["times"])
        doc, pair = (cells // len(keys), cells % len(keys)) if len(keys) else (cells, cells)
        is_best = counts == sent.value[keys & 0xFFFFFFFF]
        n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(n_best, doc, times * is_best[pair])
        np.add.at(count_sum, doc, times * counts[pair])
        return pa.table({
            key: mine.column("ids").combine_chunks().flatten(), **{c: row[c] for c in ("n_a", "n_b", "n_groups", "n_links")}, "n_best": n_best, "count_sum": count_sum,
            "groups_sha256": row["groups"],
        })

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return own.groupBy("stretch").cogroup(answers.groupBy("stretch")).applyInArrow(gather, schema)


def align_documents(docs: DataFrame, encoders: Callable[[], tuple[ExactBytes, ExactBytes]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ids ``a`` and ``b``, links as two arrays of places in them (in order), cuts as the numbers of tokens of ``a`` and ``b`` up to each.

    Same rules for texts without tokens as :func:`alignment_counts`: empty arrays.
    """
    kept = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))
    names = ["a", "b", "link_a", "link_b", "cut_a", "cut_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = encoders()
        for rows, texts in text_slices(batches, text, BATCH_CHARS):
            x = align(texts, a, b)
            order = np.lexsort((x.link_b, x.link_a))
            link_a, link_b = x.link_a[order], x.link_b[order]
            doc_a, n = np.repeat(np.arange(len(texts)), x.n_a), len(texts)
            first_a, first_b = np.cumsum(x.n_a) - x.n_a, np.cumsum(x.n_b) - x.n_b
            of_link, of_cut = doc_a[link_a], doc_a[x.cut_a]
            n_links, n_cuts = np.bincount(of_link, minlength=n), np.bincount(of_cut, minlength=n)
            lists = (
                (x.a, x.n_a), (x.b, x.n_b), (link_a - first_a[of_link], n_links), (link_b - first_b[of_link], n_links),
                (x.cut_a + 1 - first_a[of_cut], n_cuts), (x.cut_b + 1 - first_b[of_cut], n_cuts),
            )
            arrays = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(c))), pa.int32()), pa.array(v, pa.int32())) for v, c in lists]
            yield pa.RecordBatch.from_arrays([rows.column(key), *arrays], [key, *names])

    schema = ", ".join([f"`{key}` {kept.schema[key].dataType.simpleString()}", *(f"{c} array<int>" for c in names)])
    return arrow_map(kept, run, schema)
