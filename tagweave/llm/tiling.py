"""Query blocks against data blocks: tiles of bounded size, and the best k of their results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.llm.common import stored


def tiles(data: DataFrame, queries: DataFrame, data_cells: int, query_cells: int, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the key (dim, d, q) of the tile in which a data block meets a query block.

    Rows are dealt to blocks by a hash of the id, so that a block of one ``dim`` holds about ``data_cells`` or ``query_cells`` components.
    Every data block is copied once per query block and every query block once per data block; no pair of rows is formed
    here, and a tile has the same size whatever the table sizes are. The table of block numbers has a row per ``dim`` that both sides
    have; it is written first, so that Spark knows its size when it chooses the joins.
    """

    def blocks(df: DataFrame, cells: int, name: str) -> DataFrame:
        n_blocks = F.ceil(F.count(F.lit(1)) * F.greatest("dim", F.lit(1)) / F.lit(cells)).cast("long")
        return df.groupBy("dim").agg(n_blocks.alias(name))

    numbers = stored(blocks(data, data_cells, "n_d").join(blocks(queries, query_cells, "n_q"), "dim"), "blocks")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    to_all = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = data.join(numbers, "dim").select("dim", own("n_d").alias("d"), to_all("n_q").alias("q"), "id", *columns)
    right = queries.join(numbers, "dim").select("dim", to_all("n_d").alias("d"), own("n_q").alias("q"), "id", *columns)
    return left, right


def matrix(table: pa.Table, column: str, kind: type) -> np.ndarray:
    """Vectors of one length, without nulls, as the rows of a matrix."""
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in table.column(column).chunks]
    return np.concatenate(parts or [np.zeros(0)]).astype(kind, copy=False).reshape(table.num_rows, -1 if table.num_rows else 0)


def top_k(found: DataFrame, k: int, score: str) -> DataFrame:
    """Best k of the tiles' results per query: highest score first, ties to the smaller id; ``rank`` from 1.

    Spark keeps k rows per query in front of the shuffle already (a window group limit), so a query's rows never gather.
    """
    best = W.partitionBy("query_id").orderBy(F.col(score).desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", score)
