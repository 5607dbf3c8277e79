"""Ranked lexical search: a trie over documents' restricted term vectors, searched depth first by branch and bound.

Items are taken in blocks of bounded size. Of a document only the terms of the block's items matter: its restricted vector, which is
read from the whole text once and stored. Each task builds tries over shards of vectors, their terms ordered by document
frequency, the rarest first, so that a path's term also tells which rarer terms are not there. Documents with the same beginning share
its nodes; a node knows the largest tf of its term and of all deeper terms, and the smallest m, in its subtree. An item walks
the trie with a stack, deepest and most promising nodes first; what cannot reach the item's kth score so far, which is
passed on from shard to shard, is cut off. Documents that are left are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tagweave.llm.common import arrow_map, byte_table, mix, ranges, segment_sum, stored, text_slices, word_hashes

# Items of one block: their texts have about this many bytes.
BLOCK_BYTES = 4 << 20
# Postings of one trie.
SHARD_POSTINGS = 4_000_000
# Nodes or documents that are looked at together.
BATCH = 1024

# Fixed value: ASCII bytes that are no part of a term.
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = byte_table(_SEPARATORS, lower=True)


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all terms in order, number of terms per text)."""
    return word_hashes([t.encode("utf-8", "surrogatepass").translate(_TABLE) for t in texts])


def restricted_vectors(docs: DataFrame, vocabulary: np.ndarray, key: str, text: str) -> DataFrame:
    """One row per stretch of documents: ids, terms with repeats, entries per document, and the entries' terms (places in the sorted
    ``vocabulary`` of hashes) and tf."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch, texts in text_slices(batches, text):
            h, n = terms(texts)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            doc = np.repeat(np.arange(len(n)), n)[hit]
            cell, tf = np.unique(doc * len(known) + at[hit], return_counts=True)
            doc, term = cell // len(known), cell % len(known)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            ids = batch.column(key)
            columns = [one(ids), *(one(pa.array(x, pa.int32())) for x in (n, np.bincount(doc, minlength=len(n)), term, tf))]
            yield pa.RecordBatch.from_arrays(columns, ["ids", "n", "entries", "term", "tf"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"ids array<{kind}>, n array<int>, entries array<int>, term array<int>, tf array<int>"
    return arrow_map(docs.select(key, text), run, schema)


def _flat(batch: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    return np.asarray(batch.column(column).flatten() if isinstance(batch, pa.RecordBatch) else batch.column(column).combine_chunks().flatten())


def corpus_statistics(vectors: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, documents holding each vocabulary term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(_flat(batch, "term"), minlength=n_terms)
            n = _flat(batch, "n").astype(np.int64)
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
        held = np.flatnonzero(df)
        columns = [pa.array([-2, -1, *held.tolist()], pa.int64()), pa.array([docs, total, *df[held].tolist()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["term", "n"])

    sums = arrow_map(vectors.select("n", "term"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    of = dict(zip(sums.column("term").to_pylist(), sums.column("n").to_pylist(), strict=True))
    df = np.zeros(n_terms, np.int64)
    for term, n in of.items():
        if term >= 0:
            df[term] = n
    return of.get(-2, 0), of.get(-1, 0), df


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a weight is multiplied by: grows with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Shard:
    """Distinct (vector, m) of some documents: entries by falling rarity, and the ids of each, of which the least ``k`` are enough."""

    start: np.ndarray
    size: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    m: np.ndarray
    ids: list[list]

    @classmethod
    def of(cls, ids: list, n_entries: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, k: int) -> Shard:
        """``term`` is the place in the order of rarity; entries need not be in order."""
        doc = np.repeat(np.arange(len(m)), n_entries)
        order = np.lexsort((term, doc))
        term, tf = term[order].astype(np.int64), tf[order].astype(np.int64)
        start = np.cumsum(n_entries) - n_entries
        # Documents without any entry have no score.
        key = mix(segment_sum(mix(mix(term.astype(np.uint64)) + tf.astype(np.uint64)), n_entries) + mix(m.astype(np.uint64)))
        by = np.argsort(key, kind="stable")
        by = by[n_entries[by] > 0]
        head = np.concatenate((np.ones(min(1, len(by)), bool), key[by][1:] != key[by][:-1]))
        first = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))] if len(by) else by
        # Equal hashes only propose: m, sizes and entries have to agree.
        same = (m[by] == m[first]) & (n_entries[by] == n_entries[first])
        size = np.where(same, n_entries[by], 0)
        a, b = np.repeat(start[by], size) + ranges(size), np.repeat(start[first], size) + ranges(size)
        same &= segment_sum(((term[a] != term[b]) | (tf[a] != tf[b])).astype(np.int64), size) == 0
        groups: dict[int, list] = {}
        for i, f, s in zip(by.tolist(), first.tolist(), same.tolist(), strict=True):
            groups.setdefault(f if s else i, []).append(ids[i])
        kept = np.fromiter(groups, np.int64, len(groups))
        least = [sorted(g, key=lambda x: (x is None, x))[:k] if len(g) > 1 else g for g in groups.values()]
        return cls(start[kept], n_entries[kept], term, tf, m[kept], least)


class Trie:
    """Nodes by level; the children of a node, and the documents that branch off or end at it, are consecutive.

    A document leaves the shared nodes where no other one goes on with it; the rest of its vector stays with it.
    """

    def __init__(self, shard: Shard, n_terms: int):
        self.shard, self.n_terms = shard, n_terms
        m = shard.m
        # Largest tf from each entry to the end of its document.
        offset = np.repeat(np.arange(len(m))[::-1], shard.size) << 40
        at = np.repeat(shard.start, shard.size) + ranges(shard.size)
        rest = np.zeros(len(shard.tf) + 1, np.int64)
        if len(at):
            rest[at] = (np.maximum.accumulate((shard.tf[at] + offset)[::-1])[::-1]) - offset
        end = shard.start + shard.size
        term, parent, tf, low, deeper = [np.full(1, -1)], [np.full(1, -1)], [np.zeros(1, np.int64)], [np.array([m.min(initial=1)])], [np.array([rest.max()])]
        leaf_node, leaf_doc, leaf_at = [], [], []
        node, docs, level, n_nodes = np.zeros(len(m), np.int64), np.arange(len(m)), 0, 1
        while len(docs):
            place = shard.start[docs] + level
            over = place >= end[docs]
            key = node * n_terms + np.where(over, 0, shard.term[np.where(over, 0, place)])
            key[over] = -1 - docs[over]
            found, which, count = np.unique(key, return_inverse=True, return_counts=True)
            single = count[which] == 1
            leaf_node.append(node[single])
            leaf_doc.append(docs[single])
            leaf_at.append(place[single])
            shared = count > 1
            number = np.cumsum(shared) - 1 + n_nodes
            docs, place, which = docs[~single], place[~single], which[~single]
            order = np.argsort(which, kind="stable")
            if len(order):
                cuts = np.flatnonzero(np.diff(which[order], prepend=-1))
                deep = np.where(place + 1 < end[docs], rest[np.minimum(place + 1, len(rest) - 1)], 0)
                term.append(found[shared] % n_terms)
                parent.append(found[shared] // n_terms)
                tf.append(np.maximum.reduceat(shard.tf[place][order], cuts))
                low.append(np.minimum.reduceat(m[docs][order], cuts))
                deeper.append(np.maximum.reduceat(deep[order], cuts))
            node, level, n_nodes = number[which], level + 1, n_nodes + int(shared.sum())
        self.term, self.parent, self.tf, self.m, self.deeper = (np.concatenate(x) for x in (term, parent, tf, low, deeper))
        self.children = np.searchsorted(self.parent[1:], np.arange(n_nodes + 1)) + 1
        leaf_node = np.concatenate(leaf_node) if leaf_node else np.empty(0, np.int64)
        order = np.argsort(leaf_node, kind="stable")
        self.leaves = np.searchsorted(leaf_node[order], np.arange(n_nodes + 1))
        self.leaf_doc = np.concatenate(leaf_doc)[order] if leaf_doc else np.empty(0, np.int64)
        leaf_at = np.concatenate(leaf_at)[order] if leaf_at else np.empty(0, np.int64)
        inside = leaf_at < end[self.leaf_doc]
        self.leaf_term = np.where(inside, shard.term[np.where(inside, leaf_at, 0)], n_terms) if len(leaf_at) else leaf_at
        self.leaf_tf = np.where(inside, rest[np.where(inside, leaf_at, len(rest) - 1)], 0)

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        size = self.shard.size[docs]
        at = np.repeat(self.shard.start[docs], size) + ranges(size)
        w = weight[self.shard.term[at]]
        used = np.flatnonzero(w)
        tf, m = self.shard.tf[at[used]], np.repeat(self.shard.m[docs], size)[used]
        out = np.zeros(len(at), np.int64)
        out[used] = w[used] * share(tf, m)
        return segment_sum(out, size)

    def search(self, weight: np.ndarray, best: Best) -> int:
        """Add what the shard has for an item, given the weight of each term (0 for terms of other items), to its best; returns the documents scored."""
        # Sum of the weights of a term and all more frequent ones.
        behind = np.concatenate((np.cumsum(weight[::-1])[::-1], np.zeros(2, np.int64)))
        stack, scored = [(np.zeros(1, np.int64), np.zeros(1, np.int64))], 0
        while stack:
            nodes, path = stack.pop()
            bound = path + behind[self.term[nodes] + 1] * share(self.deeper[nodes], self.m[nodes])
            alive = bound >= best.least
            nodes, path = nodes[alive], path[alive]
            n = self.leaves[nodes + 1] - self.leaves[nodes]
            leaf = np.repeat(self.leaves[nodes], n) + ranges(n)
            doc = self.leaf_doc[leaf]
            bound = np.repeat(path, n) + behind[self.leaf_term[leaf]] * share(self.leaf_tf[leaf], self.shard.m[doc])
            alive = np.flatnonzero(bound >= best.least)
            order = alive[np.argsort(-bound[alive], kind="stable")]
            for i in range(0, len(order), BATCH):
                if bound[order[i]] < best.least:
                    break
                some = doc[order[i : i + BATCH]]
                scored += len(some)
                best.add(self.scores(some, weight), some, self.shard.ids)
            n = self.children[nodes + 1] - self.children[nodes]
            child = np.repeat(self.children[nodes], n) + ranges(n)
            below = np.repeat(path, n) + weight[self.term[child]] * share(self.tf[child], self.m[child])
            bound = below + behind[self.term[child] + 1] * share(self.deeper[child], self.m[child])
            alive = np.flatnonzero(bound >= best.least)
            order = alive[np.argsort(-bound[alive], kind="stable")]
            # The most promising are on top of the stack.
            stack += [(child[order[i : i + BATCH]], below[order[i : i + BATCH]]) for i in reversed(range(0, len(order), BATCH))]
        return scored


class Best:
    """An item's k best so far: (score, id), ties to the smaller id; ``least`` is the score that a document needs to get in."""

    def __init__(self, k: int):
        self.k, self.found, self.least = k, [], 1

    def add(self, scores: np.ndarray, docs: np.ndarray, ids: list[list]) -> None:
        good = np.flatnonzero(scores >= self.least)
        if len(good) > self.k:
            # Anything below the kth of these is out; ties at it stay.
            good = good[scores[good] >= np.partition(scores[good], -self.k)[-self.k]]
        if not len(good):
            return
        self.found += [(-int(scores[i]), d is None, d) for i in good.tolist() for d in ids[docs[i]]]
        self.found.sort()
        del self.found[self.k :]
        if len(self.found) == self.k:
            self.least = -self.found[-1][0]


def search_block(
    docs: DataFrame, items: list[tuple[object, np.ndarray]], schema: str, k: int, key: str, text: str, shard_postings: int
) -> DataFrame:
    """(_item, key, score): each item's ``k`` best of every task. Items are (id, distinct term hashes)."""
    vocabulary = np.unique(np.concatenate([h for _, h in items]))
    vectors = stored(restricted_vectors(docs, vocabulary, key, text), "term-vectors")
    n_docs, total, df = corpus_statistics(vectors, len(vocabulary))
    # Doubles throughout, as the definition says; terms that no document holds weigh nothing.
    weight = np.where(df > 0, np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))), 0).astype(np.int64)
    order = np.lexsort((vocabulary, df))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    own = [rank[np.searchsorted(vocabulary, h)] for _, h in items]
    sent = docs.sparkSession.sparkContext.broadcast((rank, weight[order], own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, weight, own = sent.value
        best = [Best(k) for _ in own]
        held, size = [], 0

        def search() -> None:
            ids = [x for b in held for x in b.column("ids").flatten().to_pylist()]
            n, entries, term, tf = (np.concatenate([_flat(b, c) for b in held]).astype(np.int64) for c in ("n", "entries", "term", "tf"))
            m = 10 + (90 * n * n_docs) // max(total, 1)
            trie = Trie(Shard.of(ids, entries, rank[term], tf, m, k), len(rank))
            for places, found in zip(own, best, strict=True):
                of_item = np.zeros(len(rank) + 1, np.int64)
                of_item[places] = weight[places]
                trie.search(of_item, found)

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                held.append(row)
                size += len(_flat(row, "term"))
                if size > shard_postings:
                    search()
                    held, size = [], 0
        if held:
            search()
        rows = [(i, d, -s) for i, b in enumerate(best) for s, _, d in b.found]
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["_item", key, "score"])

    kind = to_arrow_type(docs.schema[key].dataType)
    return arrow_map(vectors, run, schema)


def ranked_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES, shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """(item, rank, key, score): for each item the ``k`` documents of the highest score above 0, all if fewer; ties to the smaller key, null last.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A to Z lower-cased; they are told apart by 64-bit hashes. Null
    texts have none. Every row of ``docs`` is a document of its own, so repeated rows rank one behind the other; items that
    repeat id and text are one item, items that share an id only have a ranking each. Other columns are ignored; no documents or no
    items give no rows. Items beyond ``block_bytes`` of text are taken in several blocks, each of which meets all documents.
    """
    rows = items.select(F.col(item_key).alias("_id"), F.col(item_text).cast("string").alias("_text")).where(F.col("_text").isNotNull()).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_bytes))
    placed = stored(rows.withColumn("_block", F.pmod(F.xxhash64("_id", "_text"), F.lit(n_blocks))), "items")
    docs = docs.select(F.col(key), F.col(text).cast("string").alias(text))
    doc_kind, item_kind = docs.schema[key].dataType.simpleString(), rows.schema["_id"].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"`{item_key}` {item_kind}, rank int, `{key}` {doc_kind}, score long")
    for block in range(n_blocks):
        own = sorted((tuple(r) for r in placed.where(F.col("_block") == block).select("_id", "_text").collect()), key=str)
        found = [(i, np.unique(terms([t])[0])) for i, t in own]
        found = [(i, h) for i, h in found if len(h)]
        if not found:
            continue
        best = search_block(docs, found, f"_item long, `{key}` {doc_kind}, score long", k, key, text, shard_postings)
        order = W.partitionBy("_item").orderBy(F.col("score").desc(), F.col(key).asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        # A block's items are few by its bound.
        names = docs.sparkSession.createDataFrame([(n, i) for n, (i, _) in enumerate(found)], f"_item long, `{item_key}` {item_kind}")
        named = ranked.join(F.broadcast(names), "_item").select(item_key, "rank", key, "score")
        out = out.unionByName(named)
    return out
