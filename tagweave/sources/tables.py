"""Readers and writers for review tables, tag pools, tag mappings and outputs."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions import text as X
from tagweave.operators.layout import durable
from tagweave.sources.csv_blocks import BLOCKS_SENT, QUOTE, block_starts, csv_blocks, csv_records

REVIEW_SCHEMA = "comment_id long, product_sku string, comment_text string, name string, good_type string, good_subtype string"
POOL_SCHEMA = "good_type string, tags string"
MAPPING_SCHEMA = "good_type string, old_tags string, new_tag string"
# Cells keep the white space around them.
_CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(
    spark: SparkSession, path: str, schema: str, sep: str = ",", required: Sequence[str] = (), position: str | None = None, block_bytes: int | None = None
) -> DataFrame:
    """CSV with quoted line breaks, doubled quotes and an optional byte-order mark.

    Columns are matched by name in every file on its own: files may order them differently, lack optional ones or carry others.
    A header is one line; lines end with a line feed, or all with a carriage return before it, which cells do not keep. A file is split over many tasks, see
    :mod:`tagweave.sources.csv_blocks`, in blocks of what the session reads at once or of ``block_bytes``. ``position`` adds a column (file name, block,
    place in the block) that orders all rows.
    """
    blocks = csv_blocks(spark, path, sep, block_bytes)
    # One line of every file, not rows, comes to the driver. Files of one header are read together.
    heads = blocks.where(F.col("head").isNotNull()).groupBy("file").agg(F.min_by("head", "block").alias("head"))
    by_header: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for name, head in sorted(map(tuple, heads.toLocalIterator())):
        columns = next(csv.reader([head.removeprefix("\ufeff").rstrip("\r")], delimiter=sep))
        by_header.setdefault((tuple(columns), head.endswith("\r")), []).append(_literal(unquote(name)))
    wanted = {f.name: f.dataType for f in T.StructType.fromDDL(schema).fields}
    starts, few = durable(block_starts(blocks)), blocks.count() <= BLOCKS_SENT
    out = None
    for (header, returns), names in by_header.items():
        missing = [c for c in required if c not in header]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        fields = ", ".join(f"`{c}` {wanted[c].simpleString() if c in wanted else 'string'}" for c in header)
        records = csv_records(spark, names, starts, sep, few, block_bytes)
        record = F.replace("record", F.lit("\r\n"), F.lit("\n")) if returns else F.col("record")
        cells = F.from_csv(record, F.lit(fields), {"sep": sep, "quote": QUOTE, "escape": QUOTE, "multiLine": "true"}).alias("_cells")
        kept = [F.col(f"_cells.`{c}`").alias(c) for c in header if c in wanted]
        if position:
            kept.append(F.struct("file", "block", F.col("seq").alias("row")).alias(position))
        rows = records.select("file", "block", "seq", cells).select(*kept)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no file with a header: {path}")
    return out


def _literal(path: str) -> str:
    """A file's path with the characters escaped that file patterns give a meaning."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_reviews(
    spark: SparkSession, path: str, sep: str = ",", required: Sequence[str] = ("product_sku", "comment_text"), block_bytes: int | None = None
) -> DataFrame:
    """Raw or grouped or tagged reviews (``tags`` and list cells stay text).

    ``comment_id`` is a number if every cell is one; where any cell holds a list, as grouped files do, all cells stay text.
    """
    rows = read_csv(spark, path, REVIEW_SCHEMA.replace("comment_id long", "comment_id string") + ", tags string", sep, required, block_bytes=block_bytes)
    if "comment_id" not in rows.columns:
        return rows
    number = F.col("comment_id").try_cast("long")
    lists = rows.where(F.col("comment_id").isNotNull() & number.isNull()).limit(1).count()
    return rows if lists else rows.withColumn("comment_id", number)


def read_tag_pool(source: DataFrame | SparkSession, path: str | None = None, lower: bool = False) -> DataFrame:
    """Rows (good_type, "a; b") -> distinct long pool (good_type, tag). Takes a DataFrame, or a session and a path."""
    rows = source if isinstance(source, DataFrame) else read_csv(source, path, POOL_SCHEMA, required=("good_type", "tags"))
    return rows.select(
        X.strip("good_type").alias("good_type"), F.explode(X.parse_tags("tags", lower)).alias("tag")
    ).distinct()


def read_tag_mapping(source: DataFrame | SparkSession, path: str | None = None, order: str | None = None) -> DataFrame:
    """Rows (good_type, "old; old", new) -> long rules (good_type, old_tag, new_tag, ord), lowercased.

    ``ord`` is the rule order: column ``order`` of a DataFrame, which has no order of its own, or for a path the name of
    the file and the place in it.
    """
    if isinstance(source, DataFrame):
        if order is None:
            raise ValueError("a DataFrame of rules needs the column that orders them")
        rows = source
    else:
        rows = read_csv(source, path, MAPPING_SCHEMA, required=("good_type", "old_tags", "new_tag"), position=order or "_position")
    position = F.col(order or "_position")
    return rows.select("good_type", "old_tags", "new_tag", position.alias("ord")).select(
        "good_type",
        F.explode(X.parse_tags("old_tags", lower=True)).alias("old_tag"),
        F.coalesce(F.lower(X.strip("new_tag")), F.lit("")).alias("new_tag"),
        "ord",
    )


def mapping_rows(mapping: DataFrame, per_row: int | None = None) -> DataFrame:
    """Long rules -> rows (good_type, old_tags, new_tag, ord) as in CSV files.

    Rules with the same target and order share a row; ``per_row`` spreads them over rows of about that many old tags.
    """
    keys = ["good_type", "new_tag", "ord"]
    slot = F.lit(0)
    if per_row:
        sizes = mapping.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(per_row)).alias("_rows"))
        mapping, slot = mapping.join(sizes, keys), F.pmod(F.xxhash64("old_tag"), F.col("_rows"))
    return (
        mapping.groupBy(*keys, slot.alias("_slot"))
        .agg(X.join_tags(F.array_sort(F.collect_set("old_tag"))).alias("old_tags"))
        .select("good_type", "old_tags", "new_tag", "ord")
    )


def csv_ready(df: DataFrame, json_columns: Sequence[str] = ("comment_id", "comment_text")) -> DataFrame:
    """Array columns as text: JSON for ``json_columns``, "a; b" for the others."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            out[f.name] = F.to_json(f.name) if f.name in json_columns else X.join_tags(f.name)
    return df.withColumns(out)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", sep: str = ",", mode: str = "overwrite") -> None:
    """Parquet by default; ``csv`` turns arrays into text first."""
    if fmt == "csv":
        csv_ready(df).write.mode(mode).csv(path, sep=sep, **_CSV)
    else:
        df.write.mode(mode).format(fmt).save(path)


def write_training_pairs(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(text, tags as JSON list) CSV."""
    df.select("text", F.to_json("tags").alias("tags")).write.mode(mode).csv(path, **_CSV)
