import numpy as np
import pytest
from tagweave.operators import approximate as N
from tagweave.operators import similarity as V
from tagweave.plans.fixtures import Views

SCHEMA = "good_type string, tag_id int, vector array<double>, cosine string, _v int"


def table(spark, rows):
    return spark.createDataFrame([(g, i, None if v is None else [float(x) for x in v], "x", 1) for g, i, v in rows], SCHEMA)


def pairs(df):
    return {(r.good_type, r.id_a, r.id_b): r.cosine for r in df.collect()}


def near(n, seed, dim=16, spread=0.25):
    rng = np.random.default_rng(seed)
    return np.repeat(rng.normal(size=(n // 4, dim)), 4, axis=0) + rng.normal(scale=spread, size=(n // 4 * 4, dim))


def test_bits_reach_the_recall():
    for threshold in (0.0, 0.3, 0.8, 0.95):
        bits, same = N.projection_bits(threshold, 0.95), 1 - np.arccos(threshold) / np.pi
        assert 1 - (1 - same**bits) ** N.TABLES >= 0.95 > 1 - (1 - same ** (bits + 1)) ** N.TABLES
    with pytest.raises(ValueError):
        N.projection_bits(0.0, 0.95, 2)


@pytest.mark.parametrize("block_rows", [1000, 7])
def test_recall_and_exact_cosines(spark, block_rows):
    df = table(spark, [(g, i, v) for g, seed in (("a", 1), ("b", 2)) for i, v in enumerate(near(200, seed))]).repartition(3)
    want, got = pairs(V.similar_tag_pairs(df, 0.8)), pairs(N.approximate_tag_pairs(df, 0.8, block_rows=block_rows))
    out = N.approximate_tag_pairs(df, 0.8, block_rows=block_rows)
    assert out.count() == len(got) and set(got) <= set(want) and len(got) >= 0.9 * len(want) > 300
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_recall_on_the_given_vectors(spark):
    v = Views(spark, "/root/testdata/sf0.001").vectors()
    want, got = pairs(V.similar_tag_pairs(v, 0.3)), pairs(N.approximate_tag_pairs(v, 0.3))
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) > 100


def test_copies_and_odd_rows(spark):
    m = near(8, 3)
    rows = [("a", i, v) for i, v in enumerate(m)] + [("a", 100 + i, m[0]) for i in range(60)] + [("a", 200, 2 * m[1])]
    rows += [("a", 300, None), (None, 301, m[0]), ("a", None, m[0]), ("a", 302, 0 * m[0]), ("b", 0, m[0])]
    df = table(spark, rows)
    want = pairs(V.similar_tag_pairs(table(spark, rows[:8]), 0.8))
    assert pairs(N.approximate_tag_pairs(df, 0.8, recall=0.999999, block_rows=3)) == pytest.approx(want)
    reps = {(r.good_type, r.tag_id): r.rep_id for r in N.distinct_vectors(df, "tag_id", "good_type", "vector").collect()}
    assert reps["a", 130] == 0 and reps["a", 200] == 1 and reps["b", 0] == 0 and len(reps) == 8 + 60 + 1 + 1
    assert not pairs(N.approximate_tag_pairs(df.where("tag_id < 0"), 0.8))


def test_copies_of_a_vector_do_not_grow_with_the_table(spark, monkeypatch):
    # Sixteen buckets in each of 24 tables; every vector is copied once for each block of its bucket.
    for n in (10_000, 60_000, 500_000):
        assert n / 16 <= N.rows_per_block(N.TABLES * n, 64, V.BLOCK_ROWS)
    df = table(spark, [("a", i, v) for i, v in enumerate(near(200, 5))]).repartition(3)
    want = pairs(N.approximate_tag_pairs(df, 0.3))
    # Blocks and tiles of few rows give the same pairs.
    monkeypatch.setattr(N, "BLOCK_COMPONENTS", 16 * 9)
    monkeypatch.setattr(N, "TILE_ROWS", 4)
    got = pairs(N.approximate_tag_pairs(df, 0.3, block_rows=2))
    assert len(want) > 300 and got == pytest.approx(want)
