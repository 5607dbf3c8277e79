"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact Jaccard similarity of word shingles decides.

Equal texts are one class from the start. Each of the ``TREES`` tries orders the texts by ``DEPTH`` minima. Subtrees below the shortest
prefix that the wanted recall may ask for meet in a task and are sorted there, so that every longer prefix is a run of rows. Matched
prefixes are shortened from the whole depth: at each level only texts of different children that are not yet in one family
are compared by their whole signatures, and a subtree ends as soon as it is one family, or at the prefix that reaches the recall. Pairs
that agree too little are ruled out; the others make families, and inside a family every pair is compared
exactly. Only sums per document and one edge per document leave a task, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import arrow_map, free_names, mix, ranges, stored, text_slices, word_hashes
from tagweave.llm.components import connected_components

WORDS = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 8
RECALL = 0.9999
# Members of one prefix, or documents of one family, that meet in one tile; larger ones are cut into blocks, every two of which meet.
PREFIX_BLOCK, FAMILY_BLOCK = 1024, 512
# Rows of small prefixes or families that one task takes together.
ROWS_PER_TASK = 4096

# Bits of the filter that says which texts may have a family: 2 MiB, whatever the corpus.
FILTER_BITS = 1 << 24

_PAD = np.uint64(0x2545F4914F6CDD1D)


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Longest prefix with which a pair at the threshold shares one in some tree with probability ``recall``: where shortening ends."""
    k = depth
    while k > 1 and 1 - (1 - threshold**k) ** trees < recall:
        k -= 1
    return k


def lowest_agreement(threshold: float, n: int) -> float:
    """Share of equal minima below which a pair at the threshold practically never falls: six standard deviations."""
    return threshold - 6 * (threshold * (1 - threshold) / n) ** 0.5


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of ``words`` lower-cased words, and their number per text.

    A text of fewer words has one shingle of all of them; a text without words has none.
    """
    h, counts = word_hashes([" ".join(t.lower().split()).encode("utf-8", "surrogatepass") for t in texts])
    padded = np.where((counts > 0) & (counts < words), words, counts)
    at = np.cumsum(padded) - padded
    w = np.full(int(padded.sum()), _PAD, np.uint64)
    w[np.repeat(at, counts) + ranges(counts)] = h
    n = np.maximum(padded - words + 1, 0)
    starts = np.repeat(at, n) + ranges(n)
    run = w[starts].copy()
    for i in range(1, words):
        run = mix(run) + w[starts + i]
    return mix(run), n


def minima(hashes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """(texts, n) 32-bit minima over each text's shingles under ``n`` fixed orders; texts without shingles have the largest value."""
    out = np.full((len(counts), n), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(counts > 0)
    if not len(full):
        return out
    at = (np.cumsum(counts) - counts)[full]
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    # Texts by stretches whose shingles stay in the cache.
    stretch = np.searchsorted(at, np.arange(0, int(at[-1]) + 1, 1 << 15))
    stretch = np.unique(np.append(stretch, len(at)))
    for a, b in zip(stretch[:-1], stretch[1:], strict=True):
        own = hashes[at[a] : (at[b] if b < len(at) else int(counts.sum()))]
        places = at[a:b] - at[a]
        for i in range(n):
            order = ((own ^ seeds[2 * i]) * (seeds[2 * i + 1] | np.uint64(1))) >> np.uint64(32)
            out[full[a:b], i] = np.minimum.reduceat(order, places)
    return out


def signatures(rows: DataFrame, text: str, n: int) -> DataFrame:
    """Add ``n_shingles`` and ``signature`` (the low 16 bits of ``n`` minima as bytes); the text goes."""
    kept = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, text):
            hashes, counts = shingles(texts)
            found = minima(hashes, counts, n)
            columns = [*(batch.column(c) for c in kept), pa.array(counts, pa.int64()), pa.array([x.tobytes() for x in found.astype(np.uint16)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_shingles", "signature"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)
    return arrow_map(rows, run, f"{schema}, n_shingles long, signature binary")


def minima_of(signatures: list[bytes]) -> np.ndarray:
    """(texts, trees, DEPTH) minima."""
    return np.frombuffer(b"".join(signatures), np.uint16).reshape(len(signatures), -1, DEPTH)


def prefixes(reps: DataFrame, k: int) -> DataFrame:
    """(prefix, tree, node): one row per tree; the prefix is a hash of the tree's number and its first ``k`` minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = minima_of(batch.column("signature").to_pylist()).astype(np.uint64)
            trees = s.shape[1]
            h = mix(np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), s.shape[:2]).copy())
            for i in range(k):
                h = mix(h + s[:, :, i])
            nodes = batch.column("node").take(pa.array(np.repeat(np.arange(len(s)), trees)))
            tree = pa.array(np.tile(np.arange(trees, dtype=np.int16), len(s)))
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), tree, nodes], ["prefix", "tree", "node"])

    return arrow_map(reps.select("node", "signature"), run, "prefix long, tree short, node binary")


def in_tiles(rows: DataFrame, group: str, block_rows: int) -> DataFrame:
    """Add ``_tile``, ``_a`` and ``_b`` (whether a row is on the tile's first and second side) to rows with the group's size ``_n``.

    Groups of up to ``block_rows`` rows are dealt to tasks of about ROWS_PER_TASK rows; a larger group is cut into blocks by the hash
    of the node, and each block meets itself and every other one in tiles of their own.
    """
    n_blocks = F.ceil(F.col("_n") / F.lit(block_rows)).cast("long")
    cut = rows.withColumns({"_blocks": n_blocks, "_block": F.pmod(F.xxhash64("node"), n_blocks)})
    total = rows.count()
    n_tasks = max(1, -(-total // ROWS_PER_TASK))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_other")
    cut = cut.select("*", other)
    low, high = F.least("_block", "_other"), F.greatest("_block", "_other")
    small = F.col("_blocks") == 1
    tile = F.when(small, F.pmod(F.xxhash64(group), F.lit(n_tasks))).otherwise(F.xxhash64(group, low, high))
    return cut.withColumns({"_tile": tile, "_low": low, "_high": high, "_a": F.col("_block") == low, "_b": F.col("_block") == high}).drop(
        "_blocks", "_block", "_other", "_n"
    )


class Forest:
    """Union-find over 0..n-1 with the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def groups_of(table: pa.Table, column: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """The table's rows by (column, _low, _high), sorted by node, with the rows on each side of their tile."""
    order = [(c, "ascending") for c in (column, "_low", "_high", "node")]
    table = table.sort_by(order)
    keys = [table.column(c) for c in (column, "_low", "_high")]
    new = np.zeros(max(0, table.num_rows - 1), bool)
    for key in keys:
        codes = key.combine_chunks().dictionary_encode()
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
        new |= codes[1:] != codes[:-1]
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]
    a, b = (table.column(c).to_numpy() for c in ("_a", "_b"))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield table.slice(i, j - i), np.flatnonzero(a[i:j]), np.flatnonzero(b[i:j])


def subtree_families(paths: np.ndarray, whole: np.ndarray, side: np.ndarray | None, shortest: int, agreement: float) -> np.ndarray:
    """Family (the number of one of its rows) of every row of a subtree: ``paths`` are the tree's minima, ``whole`` the signatures.

    Rows sorted by path make a trie in which the rows below a prefix lie together. Prefixes are shortened from the longest match to
    ``shortest``; at each level rows of different children and families meet, those of different sides only where ``side`` is given.
    """
    n = len(paths)
    family = np.arange(n)
    order = np.lexsort(paths.T[::-1])
    path = paths[order]
    shared = np.clip(np.cumprod(path[1:] == path[:-1], axis=1).sum(1), shortest, None)
    child_end = np.arange(1, n + 1)
    for depth in np.unique(shared)[::-1]:
        ends = np.append(np.flatnonzero(shared < depth) + 1, n)
        end = ends[np.searchsorted(ends, np.arange(n), side="right")]
        for i in np.flatnonzero(child_end < end):
            row, others = order[i], order[child_end[i] : end[i]]
            others = others[family[others] != family[row]]
            if side is not None:
                others = others[side[others] != side[row]]
            if len(others):
                close = np.unique(family[others[(whole[others] == whole[row]).mean(1) >= agreement]])
                if len(close):
                    family[np.isin(family, close)] = family[row]
        child_end = end
        if (family == family[0]).all():
            break
    return family


def candidate_edges(members: DataFrame, shortest: int, agreement: float) -> DataFrame:
    """(a, b) that connect the texts which some tree's subtree puts into one family."""

    def run(table: pa.Table) -> pa.Table:
        found: set[tuple[bytes, bytes]] = set()
        for group, a, _ in groups_of(table, "prefix"):
            nodes = group.column("node").to_pylist()
            if len(nodes) < 2:
                continue
            s = minima_of(group.column("signature").to_pylist())
            tree = group.column("tree").to_numpy()
            side = np.zeros(len(nodes), bool)
            side[a] = True
            family = subtree_families(s[np.arange(len(s)), tree], s.reshape(len(s), -1), None if side.all() else side, shortest, agreement)
            # The smallest row of a family stands for it: rows are sorted by node.
            _, first, which = np.unique(family, return_index=True, return_inverse=True)
            found.update((nodes[first[f]], nodes[i]) for i, f in enumerate(which.tolist()) if first[f] != i)
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    tiled = in_tiles(members, "prefix", PREFIX_BLOCK)
    return tiled.groupBy("_tile").applyInArrow(run, "a binary, b binary").distinct()


def common_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) numbers of common shingles; the sets are sorted and without repetition."""
    if len(a) * len(b) <= 64:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in b] for i in a], np.int64).reshape(len(a), len(b))
    sizes = np.array([len(s) for s in sets])
    every, which, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(sets)), sizes)
    # Shingles of a single document are in no intersection; the others meet as products of 0/1 matrices, a stretch at a time.
    number = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[which]
    doc, number = doc[number >= 0], number[number >= 0]
    order = np.argsort(number, kind="stable")
    doc, number = doc[order], number[order]
    total, width = np.zeros((len(a), len(b)), np.float32), 4096
    cuts = np.searchsorted(number, np.arange(0, (number[-1] if len(number) else -1) + width + 1, width))
    for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if i == j:
            continue
        here = np.zeros((len(sets), width), np.float32)
        here[doc[i:j], number[i:j] - k * width] = 1
        total += here[a] @ here[b].T
    return total.astype(np.int64)


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root): exact comparison of the texts of each family, one row per node and tile.

    ``links`` sums the sizes of the classes on the other side of a link; ``root`` is the smallest node that links lead to in the tile.
    """

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"node": [], "links": [], "root": []}
        for group, a, b in groups_of(table, "family"):
            nodes = group.column("node").to_pylist()
            weights = group.column("weight").to_numpy()
            hashes, counts = shingles([t or "" for t in group.column("text").to_pylist()])
            sets = [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])]
            sizes = np.array([len(s) for s in sets])
            common = common_counts(sets, a, b)
            # Whole-number comparison: common / union >= threshold.
            union = sizes[a][:, None] + sizes[b] - common
            linked = (common >= threshold * union - 1e-9) & (union > 0)
            own = a[:, None] == b
            linked &= ~own
            links = np.zeros(len(nodes), np.int64)
            links[a] = linked @ weights[b]
            if len(a) < len(nodes):
                links[b] += weights[a] @ linked
            forest = Forest(len(nodes))
            for i, row in zip(a.tolist(), linked, strict=True):
                for j in b[row].tolist():
                    forest.join(i, j)
            out["node"] += nodes
            out["links"] += links.tolist()
            out["root"] += [nodes[forest.root(i)] for i in range(len(nodes))]
        return pa.table([pa.array(out["node"], pa.binary()), pa.array(out["links"], pa.int64()), pa.array(out["root"], pa.binary())], ["node", "links", "root"])

    return in_tiles(members, "family", FAMILY_BLOCK).groupBy("_tile").applyInArrow(run, "node binary, links long, root binary")


def _places(nodes: list[bytes], bits: int) -> np.ndarray:
    """(nodes, 4) places in the filter: the four words of an md5 are as good as four hashes."""
    return np.frombuffer(b"".join(nodes), "<u4").reshape(-1, 4).astype(np.int64) % bits


def with_families(texts: DataFrame, families: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``texts`` whose ``node`` may be in ``families``, by a Bloom filter of ``bits``: the texts of others need not move.

    Where families outgrow the filter it lets more rows pass; the join behind it decides. Only the filter's words come to the driver.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits, bool)
        for batch in batches:
            flags[_places(batch.column(0).to_pylist(), bits)] = True
        packed = np.packbits(flags, bitorder="little").view("<i8")
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed[at], pa.int64())], ["word", "bits"])

    found = arrow_map(families.select("node"), words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    filled = np.zeros(bits // 64, np.int64)
    filled[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(filled.tobytes())

    def may_be_in(nodes: pd.Series) -> pd.Series:
        flags, at = np.frombuffer(sent.value, np.uint8), _places(nodes.tolist(), bits)
        return pd.Series(((flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1))

    return texts.where(F.pandas_udf(may_be_in, "boolean")("node"))


def jaccard_classes(
    docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, class_id, n_links, node, class): each row's class under links of Jaccard similarity ``threshold`` or more, and its number of links.

    Similarity is that of the sets of five-word shingles of the lower-cased text, white space apart. A class is what links connect;
    ``class_id`` is its smallest key. ``n_links`` counts the other rows, copies included, that are similar enough. A text of fewer
    than five words has one shingle, so it is linked to texts of the same words only; null, empty and blank texts have none
    and are classes of their own without links. Repeated rows are copies of each other. A null key is never a class id
    unless its class has no other (then the id is null). ``node`` is the text's md5 and ``class`` tells classes apart where ids repeat or
    are null; texts without shingles have a null there. An empty table gives an empty one; other columns are ignored.
    """
    k = prefix_length(threshold, trees, DEPTH, recall)
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(key).alias("_key"), raw.alias("_text")).withColumn("node", F.unhex(F.md5(F.col("_text").cast("binary"))))
    signed = stored(signatures(base, "_text", trees * DEPTH), "signatures")
    with_words = signed.where("n_shingles > 0")
    reps = with_words.groupBy("node").agg(F.min("_key").alias("_rep"), F.count(F.lit(1)).alias("weight"), F.first("signature").alias("signature"))
    reps = stored(reps, "classes")
    # Prefixes that only one text has drop out before anything else moves.
    entries = prefixes(reps, k)
    sizes = entries.groupBy("prefix").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    shared = entries.join(sizes, "prefix").join(reps.select("node", "signature"), "node")
    edges = candidate_edges(stored(shared, "prefixes"), k, lowest_agreement(threshold, trees * DEPTH))
    families = connected_components(edges).select("node", F.col("label").alias("family"))
    size = families.groupBy("family").agg(F.count(F.lit(1)).alias("_n"))
    asked = families.join(size, "family").join(reps.select("node", "_rep", "weight"), "node")
    texts = with_families(base, families).withColumnRenamed("_text", "text")
    members = asked.join(texts, (asked["node"] == texts["node"]) & asked["_rep"].eqNullSafe(texts["_key"])).select(
        asked["node"], "family", "_n", "weight", "text"
    )
    # A repeated row brings its text once more.
    members = stored(members.dropDuplicates(["node"]), "members")
    found = stored(verified(members, threshold), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("_links"))
    # Families in one tile are settled by their roots; the parts of larger ones still have to be put together.
    classes = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = reps.select("node", "weight").join(links, "node", "left").join(classes, "node", "left")
    named = named.select("node", (F.coalesce("_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("label", "node").alias("_class"))
    named = stored(named, "named")
    ids = reps.join(named.select("node", "_class"), "node").groupBy("_class").agg(F.min("_rep").alias("class_id"))
    per_node = named.join(ids, "_class").select("node", "class_id", "n_links", "_class")
    named_rows = signed.where("n_shingles > 0").select("_key", "node").join(per_node, "node")
    result = named_rows.select(F.col("_key").alias(key), "class_id", "n_links", "node", F.col("_class").alias("class"))
    alone = signed.where("n_shingles = 0").select(
        F.col("_key").alias(key), F.col("_key").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "node", F.lit(None).cast("binary").alias("class")
    )
    return result.unionByName(alone)


def one_per_class(docs: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with all its columns: that of the smallest key, null last, and of these that of the smallest md5 of its text.

    Key and text decide together, so rows that share a key but not a class do not stand for each other. Texts without words are
    classes of their own and stay; of rows that repeat key and text one stays, but without key and words all.
    """
    own, node, text_node = free_names(docs, "_key", "_text_node", "_node")
    rows = classes.groupBy(key, "node").agg(F.first("class").alias("class"), F.count(F.lit(1)).alias("_rows"))
    best = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("_key"), F.col("node").alias("_text_node"), "_rows")).alias("_w")
    first = rows.where(F.col("class").isNotNull()).groupBy("class").agg(best).select("_w._key", "_w._text_node", "_w._rows")
    alone = rows.where(F.col("class").isNull()).select(F.col(key).alias("_key"), F.col("node").alias("_text_node"), F.when(F.col(key).isNull(), 1).otherwise(F.col("_rows")).alias("_rows"))
    first = stored(first.unionByName(alone), "first")
    once = first.where("_rows = 1").select(F.col("_key").alias(own), F.col("_text_node").alias(node))
    again = first.where("_rows > 1").select(F.col("_key").alias(own), F.col("_text_node").alias(node))
    marked = docs.withColumn(text_node, F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))))
    same = F.col(key).eqNullSafe(F.col(own)) & (F.col(text_node) == F.col(node))
    kept = marked.join(once, same, "left_semi")
    # Repeated rows are looked for in the narrow table, so that no text moves for them in vain.
    if again.limit(1).count():
        kept = kept.unionByName(marked.join(again, same, "left_semi").dropDuplicates([key, text_node]))
    return kept.drop(text_node)
