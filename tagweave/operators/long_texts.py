"""Scorer windows and leading text of products whose text fits no row, from the pieces of :func:`products.product_text_chunks`.

Pieces are dealt by ranges of (product, piece) and each range is cut into stretches of bounded size, so one product may span many. A product's part of a stretch needs to know how many
tokens stand before it and which few come after it; both are read off one narrow row per product and stretch. No task holds a whole product.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from tagweave.functions import text as T
from tagweave.operators.layout import durable
from tagweave.operators.scoring import blank_tokens

# Characters of tokens that a worker cuts into windows at once. A range is as large as Spark makes it, and its tokens take ten times their size in Python.
STRETCH_CHARS = 1 << 22


def lead_text(pieces: DataFrame, n_chars: int, key: str = "product_sku") -> DataFrame:
    """(key, text): the first ``n_chars`` characters of every product's text.

    Two pieces that follow each other are longer than a piece's limit, so with a limit of at least ``n_chars`` the first two are enough.
    """
    first = pieces.where(F.col("chunk_id") < 2).select(key, "chunk_id", F.substring("text", 1, n_chars).alias("_t"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "_t"))), lambda x: x["_t"])
    return first.groupBy(key).agg(F.substring(F.array_join(parts, " "), 1, n_chars).alias("text"))


def prompt_text(pieces: DataFrame, n_chars: int, key: str = "product_sku") -> DataFrame:
    """(key, text): the first characters of every product's text, of which stripping and cutting at ``n_chars`` makes the same as of the whole."""
    # White space at the beginning goes; a mark behind the cut keeps white space in front of it, and is cut off with the prompt.
    lead = F.ltrim("text", F.lit(T.WHITE_SPACE))
    marked = F.when(F.length(lead) > n_chars, F.concat(F.substring(lead, 1, n_chars), F.lit("."))).otherwise(lead)
    return lead_text(pieces, n_chars + 100, key).withColumn("text", marked)


def piece_windows(
    pieces: DataFrame, size: int = 256, overlap: int = 128, special: int = 2, key: str = "product_sku", part: str = "chunk_id", carry: DataFrame | None = None,
    stretch_chars: int = STRETCH_CHARS,
) -> DataFrame:
    """(key, carried columns, chunk_id, text): the token windows of every product's whole text, tokens joined by blanks.

    The same windows as :func:`scoring.token_windows` cuts from one array of blank-separated lower-case tokens. ``pieces`` has a product's
    text in pieces in the order of ``part``, between any two of which a blank stands. ``carry`` has one row per key with columns to add.
    A stretch, which a worker holds at once, has whole pieces of about ``stretch_chars`` characters, however large the task.
    """
    content = size - special
    step = content - overlap
    if step <= 0:
        raise ValueError("overlap leaves no room to advance")
    rows = pieces.select(key, F.col(part).alias("_piece"), blank_tokens("text").alias("_tokens"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, used, open_key, before = TaskContext.get().partitionId() << 32, 0, 0, None, 0
        for batch in batches:
            tokens = batch.column("_tokens")
            counts = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            chars = np.concatenate(([0], np.cumsum(pc.binary_length(tokens.flatten()).fill_null(0).to_numpy(zero_copy_only=False))))
            ends = np.cumsum(counts)
            sizes = chars[ends] - chars[ends - counts] + counts
            out: tuple[list, list, list] = ([], [], [])
            for i, (k, n, size) in enumerate(zip(batch.column(key).to_pylist(), counts.tolist(), sizes.tolist(), strict=True)):
                if used and used + size > stretch_chars:
                    task, used, open_key = task + 1, 0, None
                if open_key is None or open_key[0] != k:
                    open_key, before = (k,), 0
                for c, v in zip(out, (task, at + i, before), strict=True):
                    c.append(v)
                used, before = used + size + 1, before + n
            at += batch.num_rows
            extra = [*(pa.array(c, pa.int64()) for c in out), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *own])

    own = ("_task", "_pos", "_before", "_n")
    longs = [StructField(c, LongType()) for c in own]
    ranged = rows.repartitionByRange(key, "_piece").sortWithinPartitions(key, "_piece").mapInArrow(number, StructType([*rows.schema.fields, *longs]))
    # Written once: which pieces make up a stretch must not change any more.
    ranged = durable(ranged)
    # Per product and stretch the number of tokens and the first ones; of short pieces several may be needed.
    leads = F.collect_list(F.when(F.col("_before") < content, F.struct("_pos", F.slice("_tokens", 1, content).alias("_lead"))))
    runs = ranged.groupBy(key, "_task").agg(F.sum("_n").alias("_n"), F.slice(F.flatten(F.transform(F.array_sort(leads), lambda x: x["_lead"])), 1, content).alias("_lead"))
    order = W.partitionBy(key).orderBy("_task")
    following = F.slice(F.flatten(F.collect_list("_lead").over(order.rowsBetween(1, content))), 1, content)
    runs = runs.select(
        key, "_task", F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_n").over(W.partitionBy(key)).alias("_total"), (F.row_number().over(order) == 1).alias("_first"), following.alias("_next"),
    )
    carried: Sequence[str] = ()
    if carry is not None:
        carried = [c for c in carry.columns if c != key]
        runs = runs.join(carry, key, "left")
    # New column identities: both sides of the cogroup come from the same table.
    runs = runs.select(*[F.col(c).alias(c) for c in runs.columns])
    types = {f.name: f.dataType for f in [*ranged.schema.fields, *runs.schema.fields]}

    def cut(table: pa.Table, runs: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        of = {r[key]: r for r in runs.to_pylist()}
        codes = table.column(key).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), table.num_rows]
        out: dict[str, list] = {c: [] for c in (key, *carried, "chunk_id", "text")}
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            tokens = table.column("_tokens").slice(i, j - i).combine_chunks().flatten().to_pylist()
            r = of[table.column(key)[i].as_py()]
            n, offset, total = len(tokens), r["_offset"], r["_total"]
            n_windows = max(0, -(-(total - content) // step)) + 1
            # A window belongs to the stretch that holds its first token, the one window of an empty text to the first stretch.
            first, last = -(-offset // step), min(-(-(offset + n) // step), n_windows)
            if total == 0:
                first, last = 0, 1 if r["_first"] else 0
            tokens += r["_next"]
            for w in range(first, last):
                at = w * step - offset
                out[key].append(r[key])
                for c in carried:
                    out[c].append(r[c])
                out["chunk_id"].append(w)
                out["text"].append(" ".join(tokens[at : at + content]))
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    kinds = {c: to_arrow_type(types[c]) for c in (key, *carried)} | {"chunk_id": pa.int32(), "text": pa.string()}
    schema = ", ".join([*(f"`{c}` {types[c].simpleString()}" for c in (key, *carried)), "chunk_id int", "text string"])
    return ranged.drop("_before", "_n").groupBy("_task").cogroup(runs.groupBy("_task")).applyInArrow(cut, schema)
