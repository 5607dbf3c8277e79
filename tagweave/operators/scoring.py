"""Token windows, pluggable scorers, routing by category and the built-in token scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tagweave.functions.numeric import sigmoid
from tagweave.functions.text import strip
from tagweave.operators.layout import durable
from tagweave.operators.replies import ClientFactory, prefer_reranked, rerank
from tagweave.operators.selection import max_pool_scores, select_tags

# A scorer reads batches with the columns of its input and yields (product_sku, good_type, chunk_id, label, prob).
Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
CLIENT_TASKS_PER_GROUP = 64
# Tokens of chunks that share a dictionary. A worker holds one batch of chunks, and the distinct tokens of each chunk of a stretch as numbers.
STRETCH_TOKENS = 1 << 22


def blank_tokens(c: Column | str) -> Column:
    """Lowercase tokens separated by blanks."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(c), " "), lambda t: t != "")


def token_windows(
    df: DataFrame, tokens_col: str, size: int = 256, overlap: int = 128, special: int = 2
) -> DataFrame:
    """One row per overlapping window: ``chunk_id`` and ``window`` in place of the token array.

    ``size`` counts ``special`` marker tokens that the model adds itself. A text that fits, also an empty one,
    has one window. Windows are slices of the row's own array: no shuffle.
    """
    content = size - special
    step = content - overlap
    if step <= 0:
        raise ValueError("overlap leaves no room to advance")
    n = F.size(tokens_col)
    last = F.ceil(F.greatest(n - content, F.lit(0)) / F.lit(step)).cast("int")
    rows = df.withColumn("chunk_id", F.explode(F.sequence(F.lit(0), last)))
    window = F.slice(F.col(tokens_col), F.col("chunk_id") * step + 1, F.lit(content))
    return rows.withColumn("window", window).drop(tokens_col)


def token_windows_of_parts(
    df: DataFrame,
    tokens_col: str,
    key: str = "product_sku",
    part: str = "part",
    size: int = 256,
    overlap: int = 128,
    special: int = 2,
) -> DataFrame:
    """Windows over products whose tokens lie in several parts, the same as over the joined token array.

    Every part needs its token offset and the first tokens of the following parts. Both come from windows over
    narrow rows: counts, and at most ``content`` leading tokens per part.
    """
    content = size - special
    step = content - overlap
    if step <= 0:
        raise ValueError("overlap leaves no room to advance")
    n = F.size(tokens_col)
    before = W.partitionBy(key).orderBy(part)
    narrow = df.select(key, part, n.alias("_n"), F.slice(F.col(tokens_col), 1, content).alias("_lead"))
    # Leading tokens of the next parts; short parts may need more than one, so up to ``content`` are looked at.
    after = before.rowsBetween(1, content)
    context = narrow.select(
        key,
        part,
        F.coalesce(F.sum("_n").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_n").over(W.partitionBy(key)).alias("_total"),
        F.slice(F.flatten(F.collect_list("_lead").over(after)), 1, content).alias("_next"),
    )
    rows = df.join(context, [key, part])
    n_windows = F.ceil(F.greatest(F.col("_total") - content, F.lit(0)) / F.lit(step)) + 1
    first = F.ceil(F.col("_offset") / F.lit(step))
    last = F.least(F.ceil((F.col("_offset") + n) / F.lit(step)), n_windows) - 1
    # An empty product still has its one window, on part 0.
    own = F.when((F.col("_total") == 0) & (F.col(part) == 0), F.array(F.lit(0).cast("long"))).when(
        last >= first, F.sequence(first.cast("long"), last.cast("long"))
    )
    reach = F.concat(F.col(tokens_col), F.col("_next"))
    window = F.slice(reach, (F.col("chunk_id") * step - F.col("_offset") + 1).cast("int"), F.lit(content))
    return (
        rows.withColumn("chunk_id", F.explode(own))
        .withColumn("window", window)
        .withColumn("chunk_id", F.col("chunk_id").cast("int"))
        .drop(tokens_col, "_offset", "_total", "_next")
    )


def score(df: DataFrame, scorer: Scorer) -> DataFrame:
    """Run a user scorer over partitions; ids keep their types, a model is loaded once per task."""
    types = {c: df.schema[c].dataType.simpleString() for c in ("product_sku", "good_type")}
    schema = f"product_sku {types['product_sku']}, good_type {types['good_type']}, chunk_id int, label string, prob double"
    return df.mapInPandas(scorer, schema)


def route_category(df: DataFrame, routes: DataFrame, default: str = "accs") -> DataFrame:
    """Add ``group_key``: the model group of the category, ``default`` for unknown or missing categories."""
    r = routes.select(F.col("good_type").alias("_t"), F.col("group_key"))
    joined = df.join(r, strip("good_type") == F.col("_t"), "left").drop("_t")
    return joined.withColumn("group_key", F.coalesce("group_key", F.lit(default)))


def by_group(
    df: DataFrame, group: str = "group_key", key: str = "product_sku", tasks: int = CLIENT_TASKS_PER_GROUP, order_by: Sequence[str] = ()
) -> DataFrame:
    """Place rows so that a task sees few groups while a large group still spreads over ``tasks`` slots; rows of a group in ``order_by``."""
    slot = F.pmod(F.xxhash64(key), F.lit(tasks))
    return df.repartition(group, slot).sortWithinPartitions(group, *order_by)


def predict_by_group(
    df: DataFrame,
    routes: DataFrame,
    scorer: Scorer,
    threshold: float = 0.5,
    top_k: int | None = 8,
    default: str = "accs",
    min_tags: int = 1,
    reranker: ClientFactory | None = None,
    template: str = "{good_type}\n{text}\n{candidates}\n{max_return}",
    rerank_top_n: int = 20,
    rerank_max: int | None = None,
    tasks: int | None = None,
    threads: int = 1,
    piece: str | None = None,
    texts: DataFrame | None = None,
) -> DataFrame:
    """Route every product to its model group, score it with that group's labels, choose tags by one threshold.

    With ``reranker`` the best ``rerank_top_n`` labels, also those of probability 0, go to the client; products
    without a usable reply keep the threshold choice. The client reads ``texts`` (product_sku, text), or the texts of ``df``.

    Texts that fit no row come as pieces, see :func:`~tagweave.operators.products.product_text_chunks`, numbered by the column ``piece``: the scorer gets a
    product's pieces one behind the other in one task and never the whole text at once. Of several rows of a piece the smallest text stands for it.
    """
    rows, order = df, []
    if piece is not None:
        rows = df.groupBy("product_sku", "good_type", piece).agg(F.min("text").alias("text"))
        order = ["product_sku", "good_type", piece]
    placed = by_group(route_category(rows, routes, default), order_by=order)
    scores = max_pool_scores(score(placed, scorer))
    if reranker is None:
        return select_tags(scores, threshold, top_k, min_tags)
    scores = durable(scores)
    better = rerank(
        scores, df if texts is None else texts, reranker, template, max_candidates=rerank_top_n, max_return=rerank_max or top_k or rerank_top_n,
        positive_only=False, tasks=tasks, threads=threads,
    )
    return prefer_reranked(better, select_tags(scores, threshold, top_k, min_tags))


# -- built-in scorer ------------------------------------------------------------------------------------------


def distinct_tokens(df: DataFrame, tokens_col: str, *keys: str) -> DataFrame:
    """(keys, token): distinct tokens per row. Rows are few tokens wide, so this happens inside the row."""
    # Outer form: a plain explode makes Spark build the token array once more for an inferred size filter.
    cells = df.select(*keys, F.explode_outer(F.array_distinct(F.col(tokens_col))).alias("token"))
    return cells.where(F.col("token").isNotNull())


def fit_scorer(
    docs: DataFrame,
    truth: DataFrame,
    products: DataFrame,
    alpha: float = 1.0,
    min_df: int = 1,
    group: str = "good_type",
) -> DataFrame:
    """Weights (group, token, drop, corrections array<struct<label, c>>) from product token sets and labels.

    The weight of a token for a label is w = ln((df+ + a)/(n+ + 2a)) - ln((df- + a)/(n- + 2a)). For a pair that never occurs (df+ = 0) it is the
    label's own number, see :func:`label_bias`, less ``drop`` = ln(df + a). Only pairs that occur get a correction ``c`` to that, so the
    table grows with the pairs seen and never holds every token with every label. ``docs`` has one row per product
    (product_sku, group, ``tokens`` array), ``truth`` is distinct (product_sku, label), ``products`` distinct
    (product_sku, group).
    """
    df_all = distinct_tokens(docs, "tokens", group).groupBy(group, "token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    # Labels meet the product row before its tokens are expanded: the join moves one row per product.
    label_sets = truth.groupBy("product_sku").agg(F.collect_set("label").alias("_labels"))
    df_pos = (
        distinct_tokens(docs.join(label_sets, "product_sku"), "tokens", group, "_labels")
        .select(group, "token", F.explode("_labels").alias("label"))
        .groupBy(group, "token", "label")
        .agg(F.count(F.lit(1)).alias("df_pos"))
        .groupBy(group, "token")
        .agg(F.collect_list(F.struct("label", "df_pos")).alias("_seen"))
    )
    a = F.lit(alpha)
    # The sizes of group and label stand in w and in its form for an unseen pair alike and cancel out.
    correction = F.transform(
        F.coalesce("_seen", F.array().cast("array<struct<label:string,df_pos:bigint>>")),
        lambda x: F.struct(
            x["label"].alias("label"), (F.ln(x["df_pos"] + a) - F.ln(a) - F.ln(F.col("df") - x["df_pos"] + a) + F.ln(F.col("df") + a)).alias("c")
        ),
    )
    rows = df_all.join(df_pos, [group, "token"], "left")
    return rows.select(group, "token", F.ln(F.col("df") + a).alias("drop"), correction.alias("corrections"))


def label_bias(truth: DataFrame, products: DataFrame, alpha: float = 1.0, group: str = "good_type") -> DataFrame:
    """(group, label, bias, unseen): smoothed log-odds of the label in the group, and its part in the weight of an unseen token."""
    n_all = products.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    pos = (
        products.join(truth.select("product_sku", "label"), "product_sku")
        .groupBy(group, "label")
        .agg(F.count(F.lit(1)).alias("n_pos"))
    )
    n, n_pos, a, a2 = F.col("n"), F.col("n_pos"), F.lit(alpha), F.lit(2 * alpha)
    unseen = F.ln(a) - F.ln(n_pos + a2) + F.ln(n - n_pos + a2)
    return pos.join(n_all, group).select(group, "label", F.ln((n_pos + a) / (n - n_pos + a)).alias("bias"), unseen.alias("unseen"))


def numbered_tokens(chunk_tokens: DataFrame, group: str = "good_type", stretch_tokens: int = STRETCH_TOKENS) -> DataFrame:
    """Chunks with their distinct tokens as numbers, and what the numbers stand for, in one table.

    A task's rows are cut into stretches of at least ``stretch_tokens`` tokens. A row with a ``token`` tells its ``_number`` in the dictionary of
    ``_stretch`` and group; one without is a chunk, ``_numbers`` are its tokens' numbers in two bytes each and ``_rare`` those from 2^16 on in four. A
    token that is in many chunks stands in the dictionary once; frequent ones have small numbers.
    """
    rows = chunk_tokens.select("product_sku", group, "chunk_id", "tokens")
    own = {"_stretch": LongType(), "_numbers": BinaryType(), "_rare": BinaryType(), "token": StringType(), "_number": IntegerType()}
    schema = StructType([*(StructField(f.name, f.dataType) for f in rows.schema.fields[:3]), *(StructField(c, t) for c, t in own.items())])
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def flushed(stretch: int, held: list[tuple[pa.Table, np.ndarray, pa.DictionaryArray]]) -> Iterator[pa.RecordBatch]:
        keys = pa.concat_tables([h[0] for h in held]).combine_chunks()
        numbers, rare, of, token = _numbered(keys.column(1).combine_chunks(), np.concatenate([h[1] for h in held]), [h[2] for h in held])
        keys, n, m = [c.combine_chunks() for c in keys.columns], keys.num_rows, len(token)
        for columns in (
            [*keys, pa.array(np.full(n, stretch), types[3]), numbers, rare, pa.nulls(n, types[6]), pa.nulls(n, types[7])],
            [
                pa.nulls(m, types[0]), keys[1].take(of), pa.nulls(m, types[2]), pa.array(np.full(m, stretch), types[3]), pa.nulls(m, types[4]),
                pa.nulls(m, types[5]), token, pa.array(np.arange(m), types[7]),
            ],
        ):
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], schema.names)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("tokens")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                used = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, used + stretch_tokens, "right")))
                part = batch.slice(start, stop - start)
                # Of a batch only its distinct tokens are kept.
                held.append((pa.Table.from_batches([part.select([0, 1, 2])]), *_distinct(part.column("tokens"))))
                size, start = size + int(ends[stop - 1] - used), stop
                if size >= stretch_tokens:
                    yield from flushed(stretch, held)
                    stretch, held, size = stretch + 1, [], 0
        if held:
            yield from flushed(stretch, held)

    return rows.mapInArrow(number, schema)


def _distinct(tokens: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(number of distinct tokens of every list, the tokens of one list after the other); null is no token."""
    n = len(tokens)
    counts = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = tokens.flatten().dictionary_encode()
    row, word = np.repeat(np.arange(n), counts), flat.indices
    if word.null_count:
        row, word = row[word.is_valid().to_numpy(zero_copy_only=False)], word.drop_null()
    n_words = max(1, len(flat.dictionary))
    pairs = row * n_words + word.to_numpy(zero_copy_only=False)
    pairs.sort()
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
    row, word = np.divmod(pairs, n_words)
    return np.bincount(row, minlength=n), pa.DictionaryArray.from_arrays(pa.array(word.astype(np.int32)), flat.dictionary.cast(pa.string()))


def _numbered(groups: pa.Array, counts: np.ndarray, tokens: list[pa.DictionaryArray]) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """(each row's distinct numbers below 2^16 as bytes, those from there on, a row that has a number's group, the number's token)."""
    n = len(groups)
    tokens = pa.chunked_array(tokens).unify_dictionaries()
    dictionary = tokens.chunk(0).dictionary
    row = np.repeat(np.arange(n), counts)
    word = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in tokens.chunks])
    # Rows without a group have no weights.
    group = groups.dictionary_encode()
    if groups.null_count:
        known = groups.is_valid().to_numpy(zero_copy_only=False)[row]
        row, word = row[known], word[known]
    n_words = max(1, len(dictionary))
    number = group.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[row] * n_words + word
    n_codes = n_words * max(1, len(group.dictionary))
    if n_codes <= 8 * len(number):
        often = np.bincount(number, minlength=n_codes)
        codes = np.flatnonzero(often)
        by_count = np.argsort(-often[codes], kind="stable")
        codes = codes[by_count]
        rank = np.empty(n_codes, np.int32)
        rank[codes] = np.arange(len(codes), dtype=np.int32)
        number = rank[number]
    else:
        codes, number, often = np.unique(number, return_inverse=True, return_counts=True)
        by_count = np.argsort(-often, kind="stable")
        rank = np.empty(len(codes), np.int32)
        rank[by_count] = np.arange(len(codes), dtype=np.int32)
        codes, number = codes[by_count], rank[number]
    of = np.zeros(len(codes), np.int64)
    of[number] = row

    def packed(here: np.ndarray, kind: str) -> pa.Array:
        data = number[here].astype(kind)
        offsets = np.concatenate(([0], np.cumsum(np.bincount(row[here], minlength=n)))) * data.itemsize
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])

    often = number < 1 << 16
    token = dictionary.take(pa.array(codes % n_words, pa.int64()))
    return packed(often, "<u2"), packed(~often, "<u4"), pa.array(of, pa.int64()), token


def chunk_sums(rows: pa.Table, answers: pa.Table, most: int = 1 << 20) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """(row, label, v, k): for every row its number ``k`` of known tokens and sum ``v`` of what they drop, under a null label, and the sums of the
    corrections of each label that has any. ``answers`` are the weights of numbers; of corrections at most about ``most`` are laid out at once."""
    n = rows.num_rows
    row, number = [], []
    for column, kind in (("_numbers", "<u2"), ("_rare", "<u4")):
        values = np.frombuffer(b"".join(rows.column(column).to_pylist()), kind)
        lengths = pc.binary_length(rows.column(column)).to_numpy().astype(np.int64) // values.itemsize
        row.append(np.repeat(np.arange(n), lengths))
        number.append(values.astype(np.int64))
    row, number = np.concatenate(row), np.concatenate(number)
    named = answers.column("_number").to_numpy().astype(np.int64)
    size = int(max(number.max(initial=-1), named.max(initial=-1))) + 1
    drop = answers.column("drop").combine_chunks()
    counted = np.bincount(named, drop.is_valid().to_numpy(zero_copy_only=False), size)
    dropped = np.bincount(named, drop.fill_null(0.0).to_numpy(zero_copy_only=False), size)
    k = np.bincount(row, counted[number], n).round().astype(np.int64)
    v = -np.bincount(row, dropped[number], n)
    # Corrections of a number stand together.
    corrections = answers.column("corrections").combine_chunks()
    each = pc.list_value_length(corrections).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = corrections.flatten()
    label, c = entries.field("label").dictionary_encode(), entries.field("c").fill_null(0.0).to_numpy(zero_copy_only=False)
    n_labels, code = max(1, len(label.dictionary)), label.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(named, each)
    order = np.argsort(owner, kind="stable")
    code, c = code[order], c[order]
    have = np.bincount(owner, minlength=size)
    begin = np.cumsum(have) - have
    until = np.cumsum(have[number])
    found: tuple[list, list, list] = ([], [], [])
    at = 0
    while at < len(number):
        to = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + most, "right")))
        many = have[number[at:to]]
        place = np.repeat(begin[number[at:to]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        pair = np.repeat(row[at:to], many) * n_labels + code[place]
        if n * n_labels <= most:
            total = np.bincount(pair, c[place], n * n_labels)
            pair = np.flatnonzero(np.bincount(pair, minlength=n * n_labels))
            total = total[pair]
        else:
            pair, inverse = np.unique(pair, return_inverse=True)
            total = np.bincount(inverse, c[place], len(pair))
        for x, y in zip(found, (pair // n_labels, pair % n_labels, total), strict=True):
            x.append(y)
        at = to
    r, lab, extra = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.int64, np.int64, np.float64), found, strict=True))
    labels = pa.concat_arrays([pa.nulls(n, pa.string()), label.dictionary.take(pa.array(lab, pa.int64())).cast(pa.string())])
    sums = pa.array(np.concatenate([v, extra]), mask=np.concatenate([k == 0, np.zeros(len(r), bool)]))
    return pa.array(np.concatenate([np.arange(n), r]), pa.int64()), labels, sums, pa.array(np.concatenate([k, np.zeros(len(r), np.int64)]), pa.int64())


def score_tokens(
    chunk_tokens: DataFrame, weights: DataFrame, bias: DataFrame, group: str = "good_type"
) -> DataFrame:
    """(product_sku, group, chunk_id, label, prob) = sigmoid(bias + sum of token weights) per chunk.

    ``chunk_tokens`` is (product_sku, group, chunk_id, token array ``tokens``). With k known tokens the sum is k times the label's
    number for unseen tokens, less the tokens' ``drop``, plus the corrections of the pairs that occur. Chunks without any known token keep the
    bias alone. Tokens do not move one by one: see :func:`numbered_tokens`.
    """
    chunk = ["product_sku", group, "chunk_id"]
    coded = durable(numbered_tokens(chunk_tokens, group))
    # New column identities: both sides of the cogroup come from the same table.
    words = coded.where(F.col("token").isNotNull()).select(*[F.col(c).alias(c) for c in (group, "token", "_stretch", "_number")])
    answers = words.join(weights.select(group, "token", "drop", "corrections"), [group, "token"]).select("_stretch", "_number", "drop", "corrections")
    rows = coded.where(F.col("token").isNull()).select(*chunk, "_stretch", "_numbers", "_rare")
    types = {c: to_arrow_type(coded.schema[c].dataType) for c in chunk}

    def add_up(rows: pa.Table, answers: pa.Table) -> pa.Table:
        at, label, v, k = chunk_sums(rows, answers)
        out = {c: rows.column(c).take(at).cast(types[c]) for c in chunk}
        return pa.table({**out, "label": label, "v": v, "k": k})

    kinds = ", ".join(f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in chunk)
    parts = rows.groupBy("_stretch").cogroup(answers.groupBy("_stretch")).applyInArrow(add_up, f"{kinds}, label string, v double, k long")
    # Few rows for a chunk, nearly all added up: they move once.
    sums = parts.repartition(*chunk).groupBy(*chunk, "label").agg(F.sum("v").alias("v"), F.sum("k").alias("k"))
    of_label = F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "v")))
    per_chunk = sums.groupBy(*chunk).agg(
        F.max(F.when(F.col("label").isNull(), F.col("k"))).alias("_k"),
        F.coalesce(F.max(F.when(F.col("label").isNull(), F.col("v"))), F.lit(0.0)).alias("_drop"),
        F.map_from_entries(of_label).alias("_corrections"),
    )
    # One row per group: its labels meet every chunk of the group as one array.
    labels = bias.groupBy(group).agg(F.collect_list(F.struct("label", "bias", "unseen")).alias("_labels"))
    rows = per_chunk.join(labels, group).select(*chunk, "_k", "_drop", "_corrections", F.explode("_labels").alias("_l"))
    x = F.col("_l.bias") + F.col("_k") * F.col("_l.unseen") + F.col("_drop") + F.coalesce(F.try_element_at("_corrections", F.col("_l.label")), F.lit(0.0))
    return rows.select(*chunk, F.col("_l.label").alias("label"), sigmoid(x).alias("prob"))
