import itertools

import numpy as np
import pandas as pd
import pytest
from tagweave.operators import similarity as V
from tagweave.plans import tagging


def table(spark, m, group="g"):
    return spark.createDataFrame([(group, i, [float(x) for x in v]) for i, v in enumerate(m)], "good_type string, tag_id int, vector array<float>")


def unit(m):
    m = np.asarray(m, dtype=np.float32).astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def greedy(m, t):
    """Plain average linkage: merge the pair of clusters with the highest mean cosine while it is above t."""
    sims = unit(m) @ unit(m).T
    clusters = [[i] for i in range(len(m))]
    while len(clusters) > 1:
        best = max(((np.mean(sims[np.ix_(a, b)]), -i, -j) for (i, a), (j, b) in itertools.combinations(enumerate(clusters), 2)))
        if best[0] <= t:
            break
        i, j = -best[1], -best[2]
        clusters[i] = clusters[i] + clusters[j]
        del clusters[j]
    return {x: min(c) for c in clusters for x in c}


def blobs(n, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, dim))
    return centers[rng.integers(0, 5, n)] + rng.normal(scale=0.55, size=(n, dim))


def found(df):
    return {r["tag_id"]: r["cluster_id"] for r in df.collect()}


@pytest.mark.parametrize("t", [0.3, 0.6, 0.8, 0.91])
def test_local_clusters_equal_greedy(spark, t):
    m = blobs(60)
    assert found(V.cluster_tags(table(spark, m), t)) == greedy(m, t)


def test_distributed_rounds_equal_greedy_with_copies_and_zero(spark):
    m = blobs(40, seed=3)
    m = np.vstack([m, np.repeat(m[:1], 20, axis=0), np.zeros((2, m.shape[1]))])
    df = table(spark, m).unionByName(table(spark, m[:3], "small")).repartition(4)
    out = V.cluster_tags(df, 0.75, local_rows=10, block_rows=15)
    assert found(out.where("good_type = 'g'")) == greedy(m, 0.75)
    assert found(out.where("good_type = 'small'")) == greedy(m[:3], 0.75)


@pytest.mark.parametrize("t", [0.2, 0.9])
def test_pairs_equal_brute_force_over_many_blocks(spark, t):
    m = blobs(120, seed=4)
    sims = unit(m) @ unit(m).T
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if sims[i, j] > t}
    got = V.similar_tag_pairs(table(spark, m).repartition(3), t, block_rows=10).collect()
    assert {(r["id_a"], r["id_b"]) for r in got} == want and len(got) == len(want)
    assert all(abs(r["cosine"] - sims[r["id_a"], r["id_b"]]) < 1e-9 for r in got)


def test_pairs_of_nothing(spark):
    assert V.similar_tag_pairs(table(spark, blobs(2)).limit(0), 0.5).count() == 0


def test_blocked_matches_equal_broadcast_matches(spark):
    raw, canon = table(spark, blobs(70, seed=8)), table(spark, blobs(30, seed=9))
    rows = lambda df: sorted((r["raw_id"], r["canonical_id"], r["rank"], round(r["cosine"], 9)) for r in df.collect())
    one, many = V.map_to_canonical(raw, canon, 0.1, 3), V.map_to_canonical(raw, canon, 0.1, 3, block_rows=7)
    assert rows(one) == rows(many) and len(rows(one)) > 70
    assert V.map_to_canonical(raw, canon.limit(0), 0.1).count() == 0


def test_consolidate_pool(spark):
    vec = {"soft": [1, 0], "very soft": [0.99, 0.05], "softness": [0.98, 0.02], "red": [0, 1], "crimson": [0.03, 1], "odd": [-1, 0.2]}
    rows = [("t", k, [float(x) for x in v]) for k, v in vec.items()]
    vectors = spark.createDataFrame(rows, "good_type string, tag string, vector array<float>")
    pool = spark.createDataFrame([("t", k, 5 if k == "soft" else 1) for k in vec], "good_type string, tag string, freq int")
    tags, rules = tagging.consolidate_pool(pool, vectors, threshold=0.9)
    assert {r["tag"] for r in tags.collect()} == {"soft", "red", "odd"}
    assert {(r["old_tag"], r["new_tag"]) for r in rules.collect()} == {("very soft", "soft"), ("softness", "soft"), ("crimson", "red")}

    def client():
        return lambda p: '{"best_tag": "%s"}' % ("" if "red" in p else "Plush")

    def keep_all():
        return lambda p: '{"kept_tags": ["plush", "odd"], "mappings": [{"old": ["odd"], "new": "strange"}]}'

    tags, rules = tagging.consolidate_pool(pool, vectors, tagging.client_chooser(client), 0.9, filter_client=keep_all)
    assert {r["tag"] for r in tags.collect()} == {"plush", "odd"}
    got = {(r["old_tag"], r["new_tag"], r["ord"]) for r in rules.collect()}
    assert got == {("soft", "plush", 0), ("very soft", "plush", 0), ("softness", "plush", 0), ("odd", "strange", 1)}


def greedy_by_sums(m, t):
    """Plain average linkage over vector sums: merge the closest two clusters, smallest ids first, while they are above t."""
    sums, sizes, members = m.copy(), np.ones(len(m)), {i: [i] for i in range(len(m))}
    while True:
        heads = np.array(sorted(members))
        sims = (sums[heads] @ sums[heads].T) / np.outer(sizes[heads], sizes[heads])
        sims[np.tril_indices(len(heads))] = -np.inf
        a, b = np.unravel_index(sims.argmax(), sims.shape)
        if sims[a, b] <= t:
            return {x: min(c) for c in members.values() for x in c}
        i, j = int(heads[a]), int(heads[b])
        sums[i] += sums[j]
        sizes[i] += sizes[j]
        members[i] += members.pop(j)


def test_clusters_of_all_given_vectors_equal_plain_linkage(spark):
    from tagweave.plans.registry import LOCAL_ROWS, QUERIES

    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids = [r.vec_id for r in rows]
    m = np.array([r.embedding for r in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    assert len(m) > LOCAL_ROWS
    want = {ids[i]: ids[c] for i, c in greedy_by_sums(m, 0.35).items()}
    assert len(set(want.values())) < 0.8 * len(want)
    assert found(QUERIES["tag_clusters_by_mean"](spark, folder)) == want


def test_nearest_clusters_of_a_dense_group_write_one_row_each(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(120, 8)) * 0.2 + np.eye(8)[0] * 3
    rows = [("g", i, [float(x * (1 + i % 3)) for x in v], 1 + i % 3) for i, v in enumerate(m)]
    clusters = spark.createDataFrame(rows, "_g string, _c long, _s array<double>, _n long")
    got = {r._c: (r._o, r._sim) for r in V.nearest_clusters(clusters, 0.5, block_rows=20).collect()}
    sims = m @ m.T
    np.fill_diagonal(sims, -np.inf)
    # Means are no unit vectors here, so their product may pass one.
    assert {c: o for c, (o, _) in got.items()} == dict(enumerate(sims.argmax(1).tolist()))
    assert all(abs(s - sims[c, o]) < 1e-9 for c, (o, s) in got.items())


def test_blocks_of_a_large_table_grow_with_it_and_tiles_change_nothing():
    n = 10**6
    assert n / V.rows_per_block(n, 64, 1000) <= 32 and V.rows_per_block(900, 64, 1000) == 1000
    assert 64 * V.rows_per_block(10**9, 64, 1000) <= 1 << 21
    m = np.random.default_rng(4).normal(size=(60, 3))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -1)
    left, right = (pd.DataFrame({"_g": "g", "_ca": 0, "_ba": 0, "_cb": 0, "_bb": b, "_id": range(lo, hi), "_m": list(unit[lo:hi])}) for b, lo, hi in ((1, 0, 37), (1, 37, 60)))
    for rows in ({"left": left, "right": right}, {"left": left.assign(_bb=0), "right": left.assign(_bb=0)}):
        got = {r["_c"]: (r["_o"], r["_sim"]) for r in V.nearest_of_blocks(**rows, threshold=0.2, tile_rows=5).to_dict("records")}
        a, b = rows["left"]["_id"].to_numpy(), rows["right"]["_id"].to_numpy()
        want = {}
        for own, other in ((a, b), (b, a)):
            for i in own:
                j = other[sims[i, other].argmax()]
                if sims[i, j] > 0.2:
                    want[int(i)] = (int(j), pytest.approx(sims[i, j]))
        assert got == want


def test_a_chain_ends_in_one_task_not_in_a_round_for_each_link(spark, monkeypatch):
    # Every vector is nearer to the next one than to the one before, so that one pair is mutual at a time.
    angles = np.cumsum(0.2 * 0.97 ** np.arange(60))
    m = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    rounds, nearest = [], V.nearest_clusters

    def counted(*args):
        rounds.append(1)
        return nearest(*args)

    monkeypatch.setattr(V, "nearest_clusters", counted)
    df = table(spark, m)
    assert found(V.cluster_tags(df, 0.9, local_rows=10, block_rows=15)) == greedy(m, 0.9)
    assert len(rounds) == 1


def test_rounds_over_spark_equal_greedy(spark, monkeypatch):
    monkeypatch.setattr(V, "FINISH_COMPONENTS", 0)
    m = blobs(50, seed=12)
    m = np.vstack([m, np.repeat(m[:1], 20, axis=0), np.zeros((2, m.shape[1]))])
    df = table(spark, m).unionByName(table(spark, m[:3], "small")).repartition(4)
    out = V.cluster_tags(df, 0.7, local_rows=10, block_rows=15)
    assert found(out.where("good_type = 'g'")) == greedy(m, 0.7)


@pytest.mark.parametrize("noise", [0.5, 0.05, 1e-5])
def test_merges_in_tiles_equal_plain_ones(noise):
    """Also of vectors so near to each other that single precision does not tell them apart."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 8))
    m = unit(centers[rng.integers(0, 6, 150)] + rng.normal(scale=noise, size=(150, 8)))
    for t in (0.1, 0.6, 0.95, 1 - 1e-10):
        want = greedy_by_sums(m, t)
        assert dict(enumerate(V._merge_rounds(m, t, tile_rows=16).tolist())) == want, t


def test_a_group_is_merged_without_a_matrix_of_all_its_pairs():
    import tracemalloc

    m = unit(np.random.default_rng(3).normal(size=(6000, 8)))
    tracemalloc.start()
    V._merge_rounds(m, 0.97, tile_rows=512)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 < 8 * 6000**2
