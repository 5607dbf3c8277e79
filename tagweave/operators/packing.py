"""Greedy packing of ordered rows into chunks, in parallel however many rows one key has.

Rows in order fill a chunk until the next one would pass its limit. Where a chunk begins depends on all rows before it, but
a block of consecutive rows needs to know one number only: how much of the open chunk is used when it begins. Each block is
turned into a jump table from that number to the number it leaves behind and the chunks it opens; almost all beginnings lead to the same end,
so a table has few entries. A scan over the tables of a key gives every block its beginning, and blocks place their rows on their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tagweave.operators.layout import durable

# Copies of one row that are placed together.
COPIES = 4096


def jumps(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums before each row and behind the last, first row of the chunk behind the one that begins at each row)."""
    sums = np.concatenate(([0], np.cumsum(sizes)))
    following = np.searchsorted(sums, sums[:-1] + limit, "right") - 1
    return sums, np.maximum(following, np.arange(1, len(sizes) + 1))


def jump_table(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces (above, used, chunks) of the function of a block: of a beginning with ``u`` used, where a row does not fit any more, the first
    piece with u > ``above`` tells what is used at the end and how many chunks the block opens."""
    n = len(sizes)
    sums, following = jumps(sizes, limit)
    # Pointer doubling: chunks from each row to the end, and the beginning of the last one.
    chunks, last, to = np.ones(n + 1, np.int64), np.arange(n + 1), np.append(following, n)
    chunks[n] = 0
    while (to < n).any():
        on = to < n
        last = np.where(on, last[to], last)
        chunks += np.where(on, chunks[to], 0)
        to = to[to]
    # The open chunk cannot end behind the first row that does not fit into an empty one.
    reached = min(n, int(np.searchsorted(sums, limit, "right")))
    used, chunks = sums[n] - sums[last[:reached]], chunks[:reached]
    ends = np.flatnonzero(np.append((used[1:] != used[:-1]) | (chunks[1:] != chunks[:-1]), True))
    return limit - sums[ends + 1], used[ends], chunks[ends]


def through(used: int, total: int, limit: int, table: tuple[Sequence[int], Sequence[int], Sequence[int]]) -> tuple[int, int]:
    """(used at the end of a block, chunks it opens) for a beginning with ``used``."""
    if used + total <= limit:
        return used + total, 0
    # The bounds fall.
    above = np.asarray(table[0])
    i = int(np.searchsorted(-above, -used, "right"))
    return int(table[1][i]), int(table[2][i])


def place(sizes: np.ndarray, used: int, chunk: int, limit: int) -> np.ndarray:
    """Chunk number of every row of a block that begins with ``used`` characters in ``chunk``."""
    sums, following = jumps(sizes, limit)
    at = max(0, int(np.searchsorted(sums, limit - used, "right")) - 1)
    starts = []
    while at < len(sizes):
        starts.append(at)
        at = int(following[at])
    return chunk + np.searchsorted(np.array(starts, np.int64), np.arange(len(sizes)), "right")


def _runs(table: pa.Table, key: str) -> Iterator[tuple[int, int]]:
    codes = table.column(key).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), table.num_rows]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def packed_rows(sizes: DataFrame, limit: int, key: str, ids: Sequence[str], size: str = "_size", copies: str = "_m") -> DataFrame:
    """(ids, chunk_id, n_chunks): one row per copy of each row of ``sizes``, its chunk under greedy packing in the order of ``ids``.

    ``ids`` begins with the key and tells rows apart. Rows are dealt by ranges of ``ids``, so a key with very many rows is spread over many tasks, and no
    task reads more of it than its range.
    """
    ids = list(ids)
    n_parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / F.lit(COPIES)).cast("long"))
    rows = sizes.select(*ids, F.col(size).cast("long").alias("_size"), F.col(copies).cast("long").alias("_m"), F.explode(n_parts).alias("_k"))
    rows = rows.withColumn("_m", F.least(F.lit(COPIES), F.col("_m") - F.col("_k") * COPIES))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            columns = [pa.array(np.full(n, part), pa.int64()), pa.array(np.arange(at, at + n), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "_part", "_pos"])
            at += n

    longs = [StructField(c, LongType()) for c in ("_part", "_pos")]
    ranged = rows.repartitionByRange(*ids, "_k").sortWithinPartitions(*ids, "_k").mapInArrow(number, StructType([*rows.schema.fields, *longs]))
    # Written once: which rows make up a block must not change any more.
    ranged = durable(ranged)

    def lengths(table: pa.Table, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        copies = table.column("_m").slice(i, j - i).to_numpy()
        return np.repeat(table.column("_size").slice(i, j - i).to_numpy(), copies), copies

    def tables(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        first, out = [], {"_total": [], "_above": [], "_used": [], "_chunks": []}
        for i, j in _runs(table, key):
            own = lengths(table, i, j)[0]
            first.append(i)
            for c, v in zip(out, (int(own.sum()), *(x.tolist() for x in jump_table(own, limit))), strict=True):
                out[c].append(v)
        return table.select([key, "_part"]).take(pa.array(first, pa.int64())).append_column("_total", pa.array(out["_total"], pa.int64())).append_column(
            "_above", pa.array(out["_above"], pa.list_(pa.int64()))
        ).append_column("_used", pa.array(out["_used"], pa.list_(pa.int64()))).append_column("_chunks", pa.array(out["_chunks"], pa.list_(pa.int64())))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, used, chunk = None, 0, 0
        for batch in batches:
            begin: tuple[list, list, list] = ([], [], [])
            columns = [batch.column(c).to_pylist() for c in (key, "_total", "_above", "_used", "_chunks")]
            for k, total, *table in zip(*columns, strict=True):
                if own is None or own[0] != k:
                    # More than the limit: the first row opens chunk 0.
                    own, used, chunk = (k,), limit + 1, -1
                begin[0].append(used)
                begin[1].append(chunk)
                used, opened = through(used, total, limit, table)
                chunk += opened
                begin[2].append(chunk + 1)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("_part"), *(pa.array(c, pa.int64()) for c in begin)], [key, "_part", "_from", "_chunk", "_end"])

    lists = ", ".join(f"{c} array<long>" for c in ("_above", "_used", "_chunks"))
    kind = rows.schema[key].dataType.simpleString()
    jump = ranged.groupBy("_part").applyInArrow(tables, f"`{key}` {kind}, _part long, _total long, {lists}")
    scanned = jump.repartition(key).sortWithinPartitions(key, "_part").mapInArrow(scan, f"`{key}` {kind}, _part long, _from long, _chunk long, _end long")
    scanned = durable(scanned)
    n_chunks = scanned.groupBy(F.col(key).alias("_key")).agg(F.max("_end").cast("int").alias("n_chunks"))
    begins = scanned.join(n_chunks, F.col(key) == F.col("_key")).drop("_key", "_end")

    def placed(table: pa.Table, begins: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        of = {k: v for k, *v in zip(*(begins.column(c).to_pylist() for c in (key, "_from", "_chunk", "n_chunks")), strict=True)}
        at, chunks, total = [], [], []
        for i, j in _runs(table, key):
            own, copies = lengths(table, i, j)
            used, chunk, n = of[table.column(key)[i].as_py()]
            at.append(np.repeat(np.arange(i, j), copies))
            chunks.append(place(own, used, chunk, limit))
            total.append(np.full(len(own), n))
        out = table.select(ids).take(pa.array(np.concatenate(at)))
        return out.append_column("chunk_id", pa.array(np.concatenate(chunks), pa.int32())).append_column("n_chunks", pa.array(np.concatenate(total), pa.int32()))

    schema = StructType([*(rows.schema[c] for c in ids), StructField("chunk_id", IntegerType()), StructField("n_chunks", IntegerType())])
    return ranged.groupBy("_part").cogroup(begins.groupBy("_part")).applyInArrow(placed, schema)
