"""Exact top-k search with KD-trees per shard: median splits, tight boxes, best-first traversal, a kth score passed on."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.tiling import matrix, tiles, top_k

SHARD_ROWS = 4096
# Components of the vectors in one block of data and of queries.
DATA_CELLS, QUERY_CELLS = 1 << 20, 1 << 22
# Queries that are under way at once in a tile.
QUERY_ROWS = 4096
LEAF_ROWS = 64


def quantised(df: DataFrame, id_col: str, vector: str, scale: float) -> DataFrame:
    """(id, dim, v): components as floor(scale * x); null vectors and vectors with null or non-finite components go."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    ok = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).where(~bad)
    return ok.select(
        F.col(id_col).cast("long").alias("id"), F.size(vector).alias("dim"),
        F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long")).alias("v"),
    )


class Tree:
    """Balanced KD-tree over integer points: nodes in arrays, children of node i at 2i+1 and 2i+2, leaves hold row ranges."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.arange(len(points))
        self.lo, self.hi, self.span, self.kids = [], [], [], []
        stack = [(0, len(points), -1)]
        while stack:
            a, b, parent = stack.pop()
            rows = order[a:b]
            sub = points[rows]
            lo, hi = sub.min(0), sub.max(0)
            me = len(self.lo)
            if parent >= 0:
                self.kids[parent].append(me)
            self.lo.append(lo)
            self.hi.append(hi)
            self.span.append((a, b))
            self.kids.append([])
            widest = int(np.argmax(hi - lo)) if sub.shape[1] else 0
            if b - a > leaf_rows and sub.shape[1] and hi[widest] > lo[widest]:
                middle = (b - a) // 2
                order[a:b] = rows[np.argpartition(sub[:, widest], middle)]
                stack += [(a, a + middle, me), (a + middle, b, me)]
        self.order = order
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product that a point of each node's box can have with each query."""
        return np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T


def _exact_type(*arrays: np.ndarray) -> type:
    """float64 if all products and sums stay whole numbers below 2**53, else int64; beyond that the scores do not fit a long."""
    most = [float(np.abs(a.astype(np.float64)).max(initial=0)) for a in arrays]
    largest = most[0] * most[1] * max(1, arrays[0].shape[1])
    if largest >= 2.0**63:
        raise ValueError("inner products exceed 64-bit integers")
    return np.float64 if largest < 2.0**53 else np.int64


def search_tree(tree: Tree, points: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, bound: np.ndarray, best: list, k: int) -> None:
    """Update ``best``, a heap of (score, -id) of at most k entries, with the points of one tree."""
    queue = [(-bound[0], 0)]
    while queue:
        top, node = heapq.heappop(queue)
        if len(best) == k and -top < best[0][0]:
            return
        if tree.kids[node]:
            for child in tree.kids[node]:
                if len(best) < k or bound[child] >= best[0][0]:
                    heapq.heappush(queue, (-bound[child], child))
            continue
        a, b = tree.span[node]
        scores = points[a:b] @ query
        found = np.arange(b - a)
        if len(best) == k:
            found = np.flatnonzero(scores >= best[0][0])
        if len(found) > k + 1:
            found = found[np.lexsort((ids[a + found], -scores[found]))[: k + 1]]
        for i in found:
            entry = (int(scores[i]), -int(ids[a + i]))
            if -entry[1] == query_id:
                continue
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)


def search_tile(data: pa.Table, queries: pa.Table, k: int, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> pa.Table:
    """Best k of a tile's rows for each of the tile's queries: shard after shard, each starting from the kth score so far."""
    out: dict[str, list] = {"query_id": [], "score": [], "vec_id": []}
    if data.num_rows and queries.num_rows:
        data = data.sort_by("id")
        points, ids = matrix(data, "v", np.int64), data.column("id").to_numpy()
        all_asked, all_ids = matrix(queries, "v", np.int64), queries.column("id").to_numpy()
        kind = _exact_type(points, all_asked)
        points, all_asked = points.astype(kind), all_asked.astype(kind)
        shards = []
        for at in range(0, len(ids), shard_rows):
            tree = Tree(points[at : at + shard_rows])
            shards.append((tree, points[at : at + shard_rows][tree.order], ids[at : at + shard_rows][tree.order]))
        for at in range(0, len(all_ids), query_rows):
            asked, asked_ids = all_asked[at : at + query_rows], all_ids[at : at + query_rows].tolist()
            best: list[list] = [[] for _ in asked_ids]
            for tree, own, own_ids in shards:
                for i, bound in enumerate(tree.bounds(asked)):
                    search_tree(tree, own, own_ids, asked[i], asked_ids[i], bound, best[i], k)
            for query, found in zip(asked_ids, best, strict=True):
                for score, minus_id in found:
                    out["query_id"].append(query)
                    out["score"].append(score)
                    out["vec_id"].append(-minus_id)
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def exact_search(
    data: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: float = 256.0,
    shard_rows: int = SHARD_ROWS, data_cells: int = DATA_CELLS, query_cells: int = QUERY_CELLS,
) -> DataFrame:
    """The ``k`` rows of ``data`` with the largest integer inner product for every row of ``queries``.

    Components are floor(scale * x). Returns query_id, rank (from 1), vec_id, score (long). Ties go to the smaller id; a query
    never finds rows of its own id; fewer candidates than k give fewer rows; repeated rows count once each. Null ids, null
    vectors and vectors with null or non-finite components take no part; vectors of different lengths never meet. Inner
    products that do not fit a long raise ValueError. An empty table gives no rows; other columns are ignored.
    """
    left, right = tiles(
        quantised(data, id_col, vector, scale), quantised(queries, id_col, vector, scale), data_cells, query_cells, ["v"]
    )

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return search_tile(a, b, k, shard_rows)

    keys = ["dim", "d", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, score long, vec_id long")
    return top_k(found, k, "score")
