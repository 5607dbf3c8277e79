"""Byte-level BPE: merges are replayed over the distinct words of many documents at once, in rank order; ids decode back to bytes."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagweave.llm.common import arrow_map, kept_in_worker, ranges, text_slices
from tagweave.llm.pieces import PieceEncoder

# Text that is encoded together in a task; its new words form one corpus for the replay.
CHUNK_CHARS = 12_000_000
_NO_RANK = np.int64(1) << 40


def read_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """BPE of many words at once.

    Every adjacent pair of tokens in any word has a rank (none if its bytes are no token). An inverted index holds, for each
    rank, the positions of its pairs in the corpus of words. The lowest rank of the corpus is taken again and again, all its
    positions are merged from left to right, and only the pairs on either side of a merge are looked up anew and
    entered into the index.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    merged.append(rank)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NO_RANK)

    def one_word(self, word: bytes) -> list[int]:
        """The plain rule: merge the leftmost pair of the lowest rank until no pair is a token."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def encode(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, ids per word)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        n = int(size.sum())
        if not n:
            return np.empty(0, np.int32), size
        token = self.byte_rank[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        last = np.zeros(n, bool)
        last[np.cumsum(size)[size > 0] - 1] = True
        after = np.where(last, -1, np.arange(1, n + 1))
        before = np.full(n, -1)
        before[1:] = np.where(last[:-1], -1, np.arange(n - 1))
        alive = np.ones(n, bool)
        rank = np.full(n, _NO_RANK)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(at: np.ndarray, found: np.ndarray) -> None:
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for positions, r in zip(np.split(at, cuts), found[np.concatenate(([0], cuts))].tolist(), strict=True):
                if r in index:
                    index[r].append(positions)
                else:
                    index[r] = [positions]
                    heapq.heappush(queue, r)

        open_ = np.flatnonzero(~last)
        rank[open_] = self._ranks_of(token[open_], token[open_ + 1])
        known = open_[rank[open_] < _NO_RANK]
        if len(known):
            enter(known, rank[known])
        odd: set[int] = set()
        while queue:
            r = heapq.heappop(queue)
            listed = index.pop(r)
            at = np.unique(np.concatenate(listed))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            # In a run of overlapping pairs only every second one, counted from the left, can merge.
            chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
            if chained.any():
                run_start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            gone = after[at]
            token[at] = r
            alive[gone] = False
            nxt = after[gone]
            after[at] = nxt
            before[nxt[nxt >= 0]] = at[nxt >= 0]
            left = before[at]
            touched = np.unique(np.concatenate((at, left[left >= 0])))
            right = after[touched]
            rank[touched] = _NO_RANK
            pairs, right = touched[right >= 0], right[right >= 0]
            if not len(pairs):
                continue
            new = self._ranks_of(token[pairs], token[right])
            rank[pairs] = new
            hit = new < _NO_RANK
            if hit.any():
                pairs, new = pairs[hit], new[hit]
                if (new < r).any():
                    # Ranks that fall again: the order within such a word matters, so it is done alone afterwards.
                    odd.update(word[pairs[new < r]].tolist())
                enter(pairs, new)
        ids, sizes = token[alive].astype(np.int32), np.bincount(word[alive], minlength=len(words))
        if odd:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i in odd:
                parts[i] = np.array(self.one_word(words[i]), np.int32)
                sizes[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, sizes


class ReplayEncoder(PieceEncoder):
    def __init__(self, file: str, pattern: str):
        import regex

        super().__init__()
        self.replay = MergeReplay(read_ranks(file))
        self._find = regex.compile(pattern).findall
        tokens = [self.replay.tokens.get(r, b"") for r in range(max(self.replay.tokens) + 1)]
        self.token_size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _words(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, every distinct match of the pattern replayed once."""
        words: dict[str, int] = {}
        which, sizes = [], []
        for text in texts:
            found = self._find(text)
            which += [words.setdefault(w, len(words)) for w in found]
            sizes.append(len(found))
        ids, n = self.replay.encode([w.encode() for w in words])
        at, which = np.cumsum(n) - n, np.array(which, np.int64)
        out = ids[np.repeat(at[which], n[which]) + ranges(n[which])]
        ends = np.concatenate(([0], np.cumsum(n[which])))[np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)]
        return out, np.diff(ends)

    def encode_pieces(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self._words([p.decode() for p in pieces])

    def encode_whole(self, text: str) -> np.ndarray:
        return self._words([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.token_size[ids]
        return self.token_bytes[np.repeat(self.token_at[ids], size) + ranges(size)].tobytes()


def replay_encoder(file: str, pattern: str) -> ReplayEncoder:
    return kept_in_worker(("replay", file, pattern), lambda: ReplayEncoder(file, pattern))


def encode_documents(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids): byte-level BPE ids of every whole text as the rank file's library gives them, without special tokens.

    A null text counts as empty; empty texts have an empty list; rows are neither dropped nor joined, so repeated rows and null
    keys stay as they are. Other columns are ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = replay_encoder(ranks_file, pattern)
        for rows, texts in text_slices(batches, text, CHUNK_CHARS):
            ids, n = encoder.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(key), lists], [key, "ids"])

    kept = docs.select(key, text)
    return arrow_map(kept, run, f"{key} {kept.schema[key].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_file: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, bytes): the bytes that each ``ids`` list stands for; a null list counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = replay_encoder(ranks_file, pattern)
        for batch in batches:
            ids = batch.column("ids")
            out = [encoder.decode(np.asarray(x.values, np.int64)) if x.is_valid else b"" for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.binary())], [key, "bytes"])

    kept = encoded.select(key, "ids")
    return arrow_map(kept, run, f"{key} {kept.schema[key].dataType.simpleString()}, bytes binary")


def round_trip_digests(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the bytes decoded from the ids.

    Same rules as :func:`encode_documents`; ids stay inside the task, only digests leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = replay_encoder(ranks_file, pattern)
        for rows, texts in text_slices(batches, text, CHUNK_CHARS):
            ids, n = encoder.encode(texts)
            shown, back, at = [], [], 0
            for size in n.tolist():
                own = ids[at : at + size]
                shown.append(hashlib.sha256(",".join(map(str, own.tolist())).encode()).hexdigest())
                back.append(hashlib.sha256(encoder.decode(own)).hexdigest())
                at += size
            yield pa.RecordBatch.from_arrays(
                [rows.column(key), pa.array(n, pa.int64()), pa.array(shown), pa.array(back)],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kept = docs.select(key, text)
    kind = kept.schema[key].dataType.simpleString()
    return arrow_map(kept, run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
