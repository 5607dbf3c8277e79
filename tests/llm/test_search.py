"""Both vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import types as T

from tagweave.llm import exact_search, nearest
from tagweave.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("rank", T.StringType()), T.StructField("id", T.LongType()), T.StructField("dim", T.LongType()),
])


def usable(v, zero):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))


def brute(rows, every, k, zero, score):
    rows = [(i, v) for i, v in rows if i is not None and usable(v, zero)]
    out = []
    for q, x in rows:
        if q % every == 0:
            near = sorted((-score(x, y), i) for i, y in rows if i != q and len(x) == len(y))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def inner(x, y):
    return float((np.array(x, np.float64) * np.array(y, np.float64)).sum())


def whole(x, y):
    return int(sum(int(np.floor(256.0 * a)) * int(np.floor(256.0 * b)) for a, b in zip(x, y, strict=True)))


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def stored_vectors(spark):
    return [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]


def test_op1_is_exact(spark):
    want, found = brute(stored_vectors(spark), 20, 20, False, inner), got(QUERIES["op1_nearest"](spark, FOLDER))
    assert [x[:3] for x in found] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in found], [x[3] for x in want], rtol=0, atol=1e-12)


def test_op10_is_exact(spark):
    assert got(QUERIES["op10_exact_search"](spark, FOLDER)) == brute(stored_vectors(spark), 50, 5, True, whole)


def odd_rows():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(200)]
    rows += [(200 + i, rows[7][1]) for i in range(150)]  # a large group of equal vectors
    rows += [(400, None), (402, [0.0] * 6), (404, [1.0, None, 0, 0, 0, 0]), (406, [float("nan")] * 6), (408, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(420 + i, [float(i), 1.0]) for i in range(5)] + [(440, []), (460, [1e-3] * 6), (480, [-30.0, 5, 2, 1, 0, 0])]
    return [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]


@pytest.mark.parametrize("small", [False, True])
def test_odd_vectors(spark, small):
    rows = odd_rows()
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)
    for every, k in ((20, 20), (7, 3)):
        queries = df.where(f"vec_id % {every} = 0")
        sizes = {"data_cells": 240, "query_cells": 30} if small else {}
        found, want = got(nearest.nearest(df, queries, k, **sizes)), brute(rows, every, k, False, inner)
        assert [x[:3] for x in found] == [x[:3] for x in want]
        assert np.allclose([x[3] for x in found], [x[3] for x in want])
        sizes = {"shard_rows": 30, "data_cells": 360, "query_cells": 30} if small else {}
        assert got(exact_search.exact_search(df, queries, k, **sizes)) == brute(rows, every, k, True, whole)


def test_empty_tables_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert not got(nearest.nearest(empty, empty)) and not got(exact_search.exact_search(empty, empty))
    twice = spark.createDataFrame([(i, [float(i), 1.0], None, None, None) for i in (0, 1, 2, 2)], SCHEMA)
    one = twice.where("vec_id = 0")
    assert [(r[1], r[2]) for r in got(nearest.nearest(twice, one, 5))] == [(1, 1), (2, 2), (3, 2)]
    assert [r[2] for r in got(exact_search.exact_search(twice, one, 2))] == [1, 2]


def test_bounds_hold():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(50, 33)), rng.normal(size=(70, 33)) * rng.random((70, 1)) * 10
    value, error = nearest.Quantised(x).products(nearest.Quantised(y))
    assert (np.abs(value - x @ y.T) <= error).all()
    tree = exact_search.Tree(np.floor(256 * y).astype(np.int64), leaf_rows=4)
    q = np.floor(256 * x).astype(np.int64)
    points, bounds = np.floor(256 * y).astype(np.int64)[tree.order], tree.bounds(q)
    for node, (a, b) in enumerate(tree.span):
        assert (bounds[:, node] >= (q @ points[a:b].T).max(1)).all()


def test_products_beyond_the_range_of_a_double(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=5) * 10.0 ** rng.choice([-200, -3, 0, 150, 155, 300])).tolist()) for i in range(120)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    df = spark.createDataFrame(rows, schema)

    def score(x, y):
        with np.errstate(over="ignore"):
            return float((np.array(x, np.longdouble) * np.array(y, np.longdouble)).sum().astype(np.float64))

    found = got(nearest.nearest(df, df.where("vec_id % 3 = 0"), 20, data_cells=200, query_cells=60))
    want = brute(rows, 3, 20, False, score)
    assert any(np.isinf(x[3]) for x in want) and [x[:2] for x in found] == [x[:2] for x in want]
    # Ties of infinite scores go to the smaller id; finite ones agree up to the rounding of their sums.
    assert [x[2] for x in found if np.isinf(x[3])] == [x[2] for x in want if np.isinf(x[3])]
    for a, b in zip(found, want, strict=True):
        assert a[3] == b[3] or abs(a[3] - b[3]) <= 1e-9 * abs(b[3])


def test_queries_of_a_tile_in_several_strips():
    rng = np.random.default_rng(6)
    import pyarrow as pa

    x = rng.normal(size=(90, 4))
    ids = np.arange(90)
    data = pa.table({"id": ids, "v": x.tolist()})
    want = nearest.search_tile(data, data.slice(0, 31), 3)
    few = nearest.search_tile(data, data.slice(0, 31), 3, strip_rows=20, query_rows=7)
    order = [("query_id", "ascending"), ("vec_id", "ascending")]
    assert few.sort_by(order).select(["query_id", "vec_id"]) == want.sort_by(order).select(["query_id", "vec_id"]) and want.num_rows == 93
    whole_data = pa.table({"id": ids, "v": np.floor(256 * x).astype(np.int64).tolist()})
    want = exact_search.search_tile(whole_data, whole_data.slice(0, 31), 3)
    assert exact_search.search_tile(whole_data, whole_data.slice(0, 31), 3, 20, 7).sort_by(order) == want.sort_by(order)
