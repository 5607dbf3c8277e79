"""Output in parts that a stopped job takes up again and a later one brings up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART, RUN = "_part", "_run"
_NOTES = f"{PART} int, digest string, {RUN} long, done boolean"


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _notes(spark: SparkSession, path: str) -> DataFrame:
    """Latest note of every part: the digest of its input, the run, and whether that run finished it."""
    try:
        notes = spark.read.schema(_NOTES).parquet(f"{path}/notes")
    except AnalysisException:
        notes = spark.createDataFrame([], _NOTES)
    last = notes.groupBy(PART).agg(F.max(F.struct(RUN, "done", "digest")).alias("_l"))
    return last.select(PART, "_l.digest", f"_l.{RUN}", "_l.done")


def write_by_parts(
    todo: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, key: str = "product_sku", parts: int = 64, batches: int = 8
) -> DataFrame:
    """Run ``work`` on the rows of every part of ``todo`` whose output is not there yet; return all output as :func:`read_by_parts` does.

    A hash of ``key`` cuts the table into ``parts`` that ``work`` sees whole, some of them at once in each of at most ``batches`` jobs. Its rows must
    carry keys of its input. A part whose rows are the same as those its stored output was made from is left alone; a changed one is
    made anew and replaces the old output, one without rows any more is emptied. Each job overwrites its parts' folders and then notes them as finished, so a
    job that stops anywhere loses one batch at most, and running it again gives the table that an undisturbed run gives. A null key
    is a key like any other; an empty table gives an empty output once something was written. ``parts`` must stay the same
    for one path, and one writer at a time may use it. Columns of map type cannot be compared and are not supported.
    """
    spark = todo.sparkSession
    placed = todo.withColumn(PART, _part(key, parts))
    # Sums are not touched by the order of rows, and see repeated ones.
    digest = F.concat_ws("-", F.count(F.lit(1)), F.sum(F.xxhash64(*todo.columns).cast("decimal(38,0)")), F.sum(F.hash(*todo.columns).cast("long")))
    now = placed.groupBy(PART).agg(digest.alias("digest"))
    # A row per part: bounded by ``parts``.
    notes = {r[PART]: r for r in _notes(spark, path).collect()}
    current = {r[PART]: r["digest"] for r in now.collect()}
    current |= {p: "" for p in notes if p not in current}
    pending = sorted(p for p, d in current.items() if p not in notes or not notes[p]["done"] or notes[p]["digest"] != d)
    run = max((r[RUN] for r in notes.values()), default=0) + 1
    size = max(1, -(-len(pending) // batches))

    def note(some: list[int], done: bool) -> None:
        rows = [(p, current[p], run, done) for p in some]
        spark.createDataFrame(rows, _NOTES).coalesce(1).write.mode("append").parquet(f"{path}/notes")

    for at in range(0, len(pending), size):
        some = pending[at : at + size]
        out = work(placed.where(F.col(PART).isin(some)).drop(PART))
        own = _part(key, parts)
        # A row elsewhere would overwrite the folder of a part that is not being made.
        checked = F.when(own.isin(some), own).otherwise(F.raise_error(F.lit("a row's key is not one of its input")).cast("int"))
        note(some, False)
        out.withColumns({PART: checked, RUN: F.lit(run).cast("long")}).write.partitionBy(PART).option("partitionOverwriteMode", "dynamic").mode(
            "overwrite"
        ).parquet(f"{path}/rows")
        note(some, True)
    return read_by_parts(spark, path)


def read_by_parts(spark: SparkSession, path: str) -> DataFrame:
    """Output of all parts that are finished. Rows that an earlier or a stopped run left behind are not among them."""
    rows = spark.read.parquet(f"{path}/rows")
    done = _notes(spark, path).where("done").select(PART, RUN)
    return rows.join(done, [PART, RUN], "left_semi").drop(PART, RUN)
