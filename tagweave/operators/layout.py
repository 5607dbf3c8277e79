"""Helpers that keep skewed data spread over many tasks: exact ranks, durable tables and their folder."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Hex digits of the hash that form a rank block: 16**3 = 4096 blocks of equal expected size per group.
RANK_BLOCK_DIGITS = 3


_RUN: ContextVar[str | None] = ContextVar("tagweave_run_folder", default=None)


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediates: the open :func:`run_folder`, else the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own, which goes when Python ends.
    """
    folder = _RUN.get() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tagweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Everything that this library writes for itself inside the block goes to one folder, deleted when the block ends.

    Results have to be written or collected inside the block, as they read from that folder.
    """
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, in ``spark`` if given, else in its own session.

    Cuts the lineage and survives lost executors; also freezes values that a recomputation could change. The table
    stays until the :func:`run_folder` around it ends; without one the folder needs a retention rule.
    """
    spark = spark or df.sparkSession
    path = f"{shared_folder(spark)}/tagweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def seeded_hash(seed: int, *keys: Column | str) -> Column:
    """Hex digest that orders rows pseudo-randomly but the same way on every run and every cluster."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def _blocks(df: DataFrame, keys: list[str], by: list[str], seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_hash`` and ``_block``, a stored table of each block's size ``_n`` and the rows before it ``_before``, per group).

    Only ``by`` and the keys are read for the table; counts combine before their shuffle.
    """
    rows = df.withColumn("_hash", seeded_hash(seed, *keys)).withColumn("_block", F.substring("_hash", 1, RANK_BLOCK_DIGITS))
    sizes = rows.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_n"))
    in_order = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_block").alias("_by_block"), "_n",
        F.coalesce(F.sum("_n").over(in_order), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(*by)).alias("group_rows"),
    )
    # Stored: its size is then known, and Spark broadcasts it instead of shuffling the rows.
    return rows, durable(offsets)


def _at_block(rows: DataFrame, offsets: DataFrame, by: list[str]) -> DataFrame:
    cond = F.col("_block") == F.col("_by_block")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(offsets, cond)


def _in_block(by: list[str], keys: list[str]) -> Column:
    return F.col("_before") + F.row_number().over(W.partitionBy(*by, "_block").orderBy("_hash", *keys))


def _tidy(df: DataFrame, by: list[str]) -> DataFrame:
    return df.drop("_hash", "_block", "_by_block", "_before", "_n", *[f"_by_{c}" for c in by])


def hash_rank(
    df: DataFrame, key: str | Sequence[str], by: Sequence[str] = (), seed: int = 42, first: int | None = None
) -> DataFrame:
    """Add ``hash_rank`` (1-based, exact) and ``group_rows`` per group ``by``, in seeded hash order.

    A plain ``row_number`` would sort a whole group in one task. Here the hash prefix cuts each group into equal
    blocks: block counts give every block its offset, and only rows of one block are sorted together. With ``first`` only
    ranks up to it are returned; blocks that lie behind it fall away before anything is shuffled. ``key`` must identify a row.
    """
    keys, by = [key] if isinstance(key, str) else list(key), list(by)
    rows, offsets = _blocks(df, keys, by, seed)
    placed = _at_block(rows, offsets, by)
    if first is not None:
        placed = placed.where(F.col("_before") < first)
    out = _tidy(placed.withColumn("hash_rank", _in_block(by, keys)), by)
    return out if first is None else out.where(F.col("hash_rank") <= first)


def rank_labels(
    df: DataFrame, key: str | Sequence[str], by: Sequence[str], cuts: Callable[[DataFrame], DataFrame], names: Sequence[str], rest: str,
    column: str, seed: int = 42,
) -> DataFrame:
    """Add ``column``: ``names[i]`` for rows whose seeded hash rank in their group is at most the i-th cut, else ``rest``.

    ``cuts`` gets a table of the groups (``by``, ``group_rows``), one row per group, and returns it with ``_cut0``, ``_cut1``, ...: growing
    numbers of rows. Blocks that lie between two cuts are labelled by their offset alone, without a shuffle of their rows; only the
    few blocks that a cut goes through are sorted.
    """
    keys, by = [key] if isinstance(key, str) else list(key), list(by)
    rows, offsets = _blocks(df, keys, by, seed)
    groups = offsets.select(*[F.col(f"_by_{c}").alias(c) for c in by], "group_rows").distinct()
    limits = cuts(groups).select(*[F.col(c).alias(f"_to_{c}") for c in by], *[f"_cut{i}" for i in range(len(names))])
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"_by_{c}").eqNullSafe(F.col(f"_to_{c}"))
    offsets = durable(offsets.join(limits, same, "left").drop(*[f"_to_{c}" for c in by]))
    placed = _at_block(rows, offsets, by)
    limit = [F.coalesce(F.col(f"_cut{i}"), F.lit(0)) for i in range(len(names))]
    crossed = F.lit(False)
    for c in limit:
        crossed = crossed | ((c > F.col("_before")) & (c < F.col("_before") + F.col("_n")))

    def label(rank: Column) -> Column:
        out = F.lit(rest)
        for name, c in reversed(list(zip(names, limit, strict=True))):
            out = F.when(rank <= c, name).otherwise(out)
        return out

    whole = placed.where(~crossed).withColumn(column, label(F.col("_before") + F.col("_n")))
    cut = placed.where(crossed).withColumn("_rank", _in_block(by, keys)).withColumn(column, label(F.col("_rank"))).drop("_rank")
    return _tidy(whole.unionByName(cut), by).drop("group_rows", *[f"_cut{i}" for i in range(len(names))])


def first_by(value: str, order: Column, ignore_nulls: bool) -> Column:
    """Value of the first row in ``order``; the first non-null value with ``ignore_nulls``."""
    if ignore_nulls:
        return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), order))
    return F.min_by(F.struct(F.col(value)), order)[value]
