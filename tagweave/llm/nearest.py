"""Nearest neighbours by a block matrix join: int8 tile products with error bounds, exact products for what survives, heaps to merge."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.tiling import matrix, tiles, top_k

# Components of the vectors in one block of data and of queries. Queries are fewer than data as a rule, and their blocks decide
# how often the data are copied.
DATA_CELLS, QUERY_CELLS = 1 << 20, 1 << 22
# Rows of data and of queries whose products are formed at once.
STRIP_ROWS, QUERY_ROWS = 4096, 512


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, dim, v) without null, zero or non-finite vectors and without null ids."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    ok = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).where(~bad & F.exists(x, lambda e: e != 0))
    return ok.select(F.col(id_col).cast("long").alias("id"), F.size(vector).alias("dim"), F.col(vector).cast("array<double>").alias("v"))


class Quantised:
    """int8 codes of vectors over their largest component, the norm of what the codes show and of what they miss."""

    def __init__(self, x: np.ndarray):
        self.scale = np.abs(x).max(1)
        x = x / self.scale[:, None]
        self.codes = np.rint(x * 127).astype(np.int8)
        shown = self.codes / 127.0
        self.norm = np.sqrt((shown * shown).sum(1))
        self.miss = np.sqrt(((x - shown) ** 2).sum(1))

    def products(self, other: Quantised) -> tuple[np.ndarray, np.ndarray]:
        """(approximate inner products, largest possible error): <x, y> = <x', y'> + <x - x', y> + <x', y - y'>.

        Both are those of the vectors over their largest components, multiplied by these; beyond the range of a double they are not finite.
        """
        # Products of int8 codes are whole and, for up to 1,000 components, exact in float32; longer vectors take float64.
        n = self.codes.shape[1]
        kind = np.float32 if n <= 1000 else np.float64
        dot = self.codes.astype(kind) @ other.codes.astype(kind).T
        full = other.norm + other.miss
        error = np.outer(self.miss, full) + np.outer(self.norm, other.miss)
        # Rounding: of these bounds, and of a score that is summed in doubles.
        error = error * (1 + 1e-9) + np.outer(self.norm + self.miss, full) * (1e-12 + 1e-15 * n)
        with np.errstate(over="ignore", invalid="ignore", under="ignore"):
            scale = np.outer(self.scale, other.scale)
            return dot.astype(np.float64) * (1 / 127**2) * scale, error * scale + 1e-300


class Strip:
    """Consecutive rows of a tile with their codes. Equal vectors are worked on once."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
        _, first, which = np.unique(rows, return_index=True, return_inverse=True)
        self.ids, self.vectors = ids, x[first]
        self.coded = Quantised(self.vectors)
        self.members = np.argsort(which, kind="stable")
        self.cuts = np.concatenate(([0], np.cumsum(np.bincount(which))))

    def holders(self, vector: int, n: int) -> np.ndarray:
        """The ``n`` smallest ids of the rows that have this vector."""
        return self.ids[self.members[self.cuts[vector] : self.cuts[vector + 1]][:n]]


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision; where partial sums leave its range, by way of longer numbers."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (x * y).sum(1)
        wide = np.flatnonzero(~np.isfinite(out))
        if len(wide):
            out[wide] = (x[wide].astype(np.longdouble) * y[wide]).sum(1).astype(np.float64)
    return out


def search_strip(strip: Strip, asked: np.ndarray, asked_ids: np.ndarray, coded: Quantised, heaps: list[list], kth: np.ndarray, k: int) -> None:
    """Update the queries' heaps of (score, -id) and their kth scores with the rows of one strip."""
    value, error = coded.products(strip.coded)
    with np.errstate(invalid="ignore"):
        known = np.isfinite(value) & np.isfinite(error)
        low, high = np.where(known, value - error, -np.inf), np.where(known, value + error, np.inf)
    # A query's own row may be among the k + 1 best; the others still reach the (k + 1)-th.
    floor = kth if low.shape[1] <= k else np.maximum(kth, np.partition(low, -(k + 1), axis=1)[:, -(k + 1)])
    q, c = np.nonzero(high >= floor[:, None])
    exact = exact_products(asked[q], strip.vectors[c])
    ends = np.searchsorted(q, np.arange(len(asked) + 1))
    for i, heap in enumerate(heaps):
        own = slice(ends[i], ends[i + 1])
        score, found = exact[own], c[own]
        for j in _best(score, k + 1):
            if len(heap) == k and score[j] < heap[0][0]:
                continue
            for vec_id in strip.holders(found[j], k + 1).tolist():
                entry = (float(score[j]), -vec_id)
                if vec_id == asked_ids[i]:
                    continue
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
        if len(heap) == k:
            kth[i] = heap[0][0]


def search_tile(data: pa.Table, queries: pa.Table, k: int, strip_rows: int = STRIP_ROWS, query_rows: int = QUERY_ROWS) -> pa.Table:
    """Best k rows of a tile for each of its queries, a heap of (score, -id) per query; few queries are under way at once."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if data.num_rows and queries.num_rows:
        data = data.sort_by("id")
        ids, x = data.column("id").to_numpy(), matrix(data, "v", np.float64)
        all_ids, all_asked = queries.column("id").to_numpy(), matrix(queries, "v", np.float64)
        strips = [Strip(x[at : at + strip_rows], ids[at : at + strip_rows]) for at in range(0, len(x), strip_rows)]
        for at in range(0, len(all_ids), query_rows):
            asked, asked_ids = all_asked[at : at + query_rows], all_ids[at : at + query_rows]
            heaps: list[list] = [[] for _ in asked]
            coded, kth = Quantised(asked), np.full(len(asked), -np.inf)
            for strip in strips:
                search_strip(strip, asked, asked_ids, coded, heaps, kth, k)
            pairs = np.array([e for heap in heaps for e in heap], np.dtype("f8,i8"))
            parts.append((np.repeat(asked_ids, [len(h) for h in heaps]), pairs["f0"], -pairs["f1"]))
    kinds = {"query_id": pa.int64(), "score": pa.float64(), "vec_id": pa.int64()}
    columns = zip(*parts, strict=True) if parts else ([], [], [])
    return pa.table({c: pa.array(np.concatenate([*v, np.zeros(0, t.to_pandas_dtype())]), t) for (c, t), v in zip(kinds.items(), columns, strict=True)})


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """Places of all scores that reach the n-th largest."""
    if len(score) <= n:
        return np.arange(len(score))
    return np.flatnonzero(score >= np.partition(score, -n)[-n])


def nearest(
    data: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding",
    data_cells: int = DATA_CELLS, query_cells: int = QUERY_CELLS,
) -> DataFrame:
    """The ``k`` rows of ``data`` with the largest inner product for every row of ``queries``.

    Returns query_id, rank (from 1), vec_id, score (double, from the original components). The quantisation bounds only rule out rows
    that cannot be among the best, so the result is exact. Ties go to the smaller id; a query never finds rows of its own
    id; fewer candidates than k give fewer rows; repeated rows count once each. Null ids and vectors that are null, zero or hold
    null or non-finite components take no part; vectors of different lengths never meet. A score beyond the range of a double is
    infinite. An empty table gives no rows; other columns are ignored.
    """
    left, right = tiles(usable(data, id_col, vector), usable(queries, id_col, vector), data_cells, query_cells, ["v"])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return search_tile(a, b, k)

    keys = ["dim", "d", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, score double, vec_id long")
    return top_k(found, k, "score")
