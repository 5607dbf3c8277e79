"""Greedy packing by jump tables against the plain loop."""

import numpy as np
from pyspark.sql import functions as F

from tagweave.operators import packing as P
from tagweave.operators import products as A


def plain(sizes, limit):
    out, chunk, used = [], -1, limit + 1
    for size in sizes:
        if used + size > limit:
            chunk, used = chunk + 1, size
        else:
            used += size
        out.append(chunk)
    return out, used


def test_blocks_put_together_are_the_plain_loop():
    rng = np.random.default_rng(9)
    for limit in (1, 10, 37):
        for _ in range(60):
            sizes = rng.choice([0, 0, 1, 2, 3, 9, 10, 11, 36, 37, 38, 80], rng.integers(1, 60))
            cuts = np.sort(rng.integers(0, len(sizes) + 1, 4)).tolist()
            used, chunk, out = limit + 1, -1, []
            for i, j in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
                block = sizes[i:j]
                if not len(block):
                    continue
                out += P.place(block, used, chunk, limit).tolist()
                used, opened = P.through(used, int(block.sum()), limit, P.jump_table(block, limit))
                chunk += opened
            assert (out, used) == plain(sizes.tolist(), limit)


def test_tables_stay_small():
    rng = np.random.default_rng(1)
    table = P.jump_table(rng.integers(1, 500, 20_000), 6000)
    assert len(table[0]) < 200


def test_chunks_of_a_hot_product(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", i, "x" * int(rng.integers(0, 40))) for i in range(3000)] + [(f"p{i % 50}", i, "y" * (i % 23)) for i in range(400)]
    rows += [("same", 1, "z" * 7)] * 5000 + [("null", 1, None), ("null", 2, "n" * 200), ("null", 3, None), (None, 1, "gone"), ("empty", 1, "")]
    df = spark.createDataFrame(rows, "product_sku string, comment_id long, comment_text string").repartition(7)
    found = A.review_chunks(df, 100).collect()
    want = {}
    for sku in {r[0] for r in rows if r[0]}:
        own = sorted((r for r in rows if r[0] == sku), key=lambda r: r[1])
        chunks = plain([len(r[2] or "") for r in own], 100)[0]
        for c, r in zip(chunks, own, strict=True):
            want.setdefault((sku, c, chunks[-1] + 1), []).append(r[2])
    assert {(r.product_sku, r.chunk_id, r.n_chunks): r.reviews for r in found} == want
    ids = ["product_sku", "comment_id"]
    sizes = df.where("product_sku = 'hot'").select(*ids, F.length("comment_text").alias("_size"), F.lit(1).alias("_m"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = P.packed_rows(sizes, 100, "product_sku", ids)
        # One product over several tasks.
        assert placed.select(F.spark_partition_id().alias("p")).distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
