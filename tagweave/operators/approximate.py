"""Close pairs of tag vectors by random projections: most pairs above a threshold at a cost that does not grow with all pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators.layout import durable
from tagweave.operators.similarity import BLOCK_COMPONENTS, BLOCK_ROWS, TILE_ROWS, unit_vector

TABLES = 24
# Rows of small buckets that one task takes together.
ROWS_PER_TASK = 8192
# A block holds this part of all buckets' rows at most, so that a few large buckets still make many tasks.
BLOCK_PARTS = 64
_TILE = ("_g", "_t", "_key", "_low", "_high")


def projection_bits(threshold: float, recall: float, tables: int = TABLES) -> int:
    """Most signs per table with which a pair of cosine ``threshold`` shares all of one table's signs with probability ``recall``."""
    same = 1 - math.acos(threshold) / math.pi
    bits = 1
    while bits < 62 and 1 - (1 - same ** (bits + 1)) ** tables >= recall:
        bits += 1
    if 1 - (1 - same**bits) ** tables < recall:
        raise ValueError("the recall needs more tables")
    return bits


def rows_per_block(n_members: int, width: int, block_rows: int) -> int:
    """Rows of a bucket's blocks: ``block_rows``, more for ``n_members`` rows of ``width`` components in all buckets, up to ``BLOCK_COMPONENTS``.

    Every vector goes to each block of its bucket: blocks of a fixed size would make the copies grow with the square of the table.
    """
    return max(block_rows, min(-(-n_members // BLOCK_PARTS), BLOCK_COMPONENTS // max(1, width)))


def distinct_vectors(df: DataFrame, id_col: str, group: str, vector: str) -> DataFrame:
    """(group, id, rep_id): each vector's smallest id among equal vectors of its group, after scaling to length one.

    Rows with a null group, id or vector and zero vectors, which are close to nothing, are left out.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(group).alias("_g"), F.col(id_col).alias("_id"), unit_vector(vector).alias("_v")
    )
    rows = rows.where(F.exists("_v", lambda x: x != 0))
    reps = rows.groupBy("_g", "_v").agg(F.min("_id").alias("_rep"))
    return rows.join(reps, ["_g", "_v"]).select(F.col("_g").alias(group), F.col("_id").alias(id_col), F.col("_rep").alias("rep_id"))


def approximate_tag_pairs(
    df: DataFrame,
    threshold: float,
    recall: float = 0.95,
    tables: int = TABLES,
    seed: int = 7,
    id_col: str = "tag_id",
    group: str = "good_type",
    vector: str = "vector",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Pairs (group, id_a < id_b, cosine) of one group with cosine strictly above ``threshold`` (>= 0); cosines are exact.

    Signs of random projections place every vector in one bucket per table; vectors of one bucket are compared, a pair only in the first
    table in which both share one. A pair at the threshold is found with probability ``recall``, a closer one with a higher one; a pair
    that is not close enough is never returned. Equal vectors stand for each other: pairs are those of their smallest ids, and
    :func:`distinct_vectors` gives the membership. A bucket of many vectors is cut into blocks, every two of which meet in a task of their
    own; blocks of ``block_rows`` grow with the table, see :func:`rows_per_block`. Null groups, ids and vectors and zero vectors have no pairs; an empty table gives none; all
    vectors have one length; other columns are ignored. For all pairs without exception see ``similar_tag_pairs``.
    """
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    bits = projection_bits(threshold, recall, tables)

    @F.pandas_udf("array<long>")
    def signs(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy())
        # The same draws in every task.
        planes = np.random.default_rng(seed).normal(size=(x.shape[1], tables * bits))
        above = (x @ planes > 0).reshape(len(x), tables, bits)
        return pd.Series(list(above @ (1 << np.arange(bits, dtype=np.int64))))

    rows = df.where(F.col(group).isNotNull() & F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(group).alias("_g"), F.col(id_col).alias("_id"), unit_vector(vector).alias("_v")
    )
    reps = rows.where(F.exists("_v", lambda x: x != 0)).groupBy("_g", "_v").agg(F.min("_id").alias("_id"))
    placed = durable(reps.withColumn("_keys", signs("_v")))
    buckets = placed.select("_g", F.posexplode("_keys").alias("_t", "_key")).groupBy("_g", "_t", "_key").agg(F.count(F.lit(1)).alias("_n"))
    # A vector alone in its bucket goes no further.
    shared = durable(buckets.where("_n > 1"))
    n_members, width = shared.agg(F.sum("_n")).first()[0] or 0, placed.agg(F.max(F.size("_v"))).first()[0]
    n_tasks, block_rows = max(1, -(-n_members // ROWS_PER_TASK)), rows_per_block(n_members, width or 1, block_rows)
    members = placed.select("*", F.posexplode("_keys").alias("_t", "_key")).join(shared, ["_g", "_t", "_key"])
    n_blocks = F.ceil(F.col("_n") / F.lit(block_rows)).cast("long")
    cut = members.withColumns({"_blocks": n_blocks, "_block": F.pmod(F.xxhash64("_id"), n_blocks)})
    cut = cut.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_other"))
    low, high = F.least("_block", "_other"), F.greatest("_block", "_other")
    small = F.pmod(F.xxhash64("_g", "_t", "_key"), F.lit(n_tasks))
    tiled = cut.select(
        "_g", "_t", "_key", low.alias("_low"), high.alias("_high"), "_id", "_v", "_keys", (F.col("_block") == low).alias("_a"),
        (F.col("_block") == high).alias("_b"), F.when(F.col("_n") <= F.lit(min(block_rows, ROWS_PER_TASK)), small).otherwise(F.xxhash64("_g", "_t", "_key", low, high)).alias("_tile"),
    )
    id_type, group_type = (df.schema[c].dataType.simpleString() for c in (id_col, group))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        table = table.sort_by([(c, "ascending") for c in (*_TILE, "_id")]).combine_chunks()
        n = table.num_rows
        v, keys = (np.asarray(table.column(c).combine_chunks().flatten()).reshape(n, -1) for c in ("_v", "_keys"))
        a, b, t = (table.column(c).to_numpy() for c in ("_a", "_b", "_t"))
        names = table.select(["_g", "_id"]).combine_chunks()
        new = np.zeros(max(0, n - 1), bool)
        for c in _TILE:
            column = table.column(c)
            new |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy()
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), n]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            left, right = i + np.flatnonzero(a[i:j]), i + np.flatnonzero(b[i:j])
            # Inside one block each pair shows twice; between two blocks once, in either order of the ids.
            same = len(left) == j - i
            for p in range(0, len(left), TILE_ROWS):
                for q in range(p if same else 0, len(right), TILE_ROWS):
                    sims = v[left[p : p + TILE_ROWS]] @ v[right[q : q + TILE_ROWS]].T
                    k, m = np.nonzero(sims > threshold)
                    x, y, cosine = left[k + p], right[m + q], sims[k, m]
                    once = x < y if same else x != y
                    x, y, cosine = x[once], y[once], cosine[once]
                    x, y = np.minimum(x, y), np.maximum(x, y)
                    first = (keys[x] == keys[y]).argmax(1) == t[x]
                    x, y, cosine = x[first], y[first], cosine[first]
                    if len(x):
                        group_of, id_a, id_b = names.column("_g").take(x), names.column("_id").take(x), names.column("_id").take(y)
                        columns = [c.combine_chunks() for c in (group_of, id_a, id_b)]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(cosine)], [group, "id_a", "id_b", "cosine"])

    return tiled.groupBy("_tile").applyInArrow(compare, f"{group} {group_type}, id_a {id_type}, id_b {id_type}, cosine double")
