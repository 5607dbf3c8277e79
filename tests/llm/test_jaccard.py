"""The similarity join against all pairs compared one by one."""

import random
from collections import Counter, defaultdict

import numpy as np

from tagweave.llm import jaccard
from tagweave.llm.components import connected_components
from tagweave.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, threshold=0.8):
    """doc_id -> (class id, links) for rows (doc_id, text)."""
    sets, n = [shingle_set(t) for _, t in rows], len(rows)
    links, up = [0] * n, list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    ids = {}
    for i in range(n):
        ids.setdefault(root(i), []).append(rows[i][0])
    return sorted(((rows[i][0], min((x for x in ids[root(i)] if x is not None), default=None), links[i]) for i in range(n)), key=str)


def got(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=str)


def family(rng, words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_op3_on_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = got(QUERIES["op3_jaccard"](spark, FOLDER))
    assert found == brute(rows) and any(n for _, _, n in found)


def test_families_in_tiles_and_odd_texts(spark, make_docs, odd_texts, monkeypatch):
    rng = random.Random(4)
    texts = list(odd_texts) + ["A b  C d e f", "a b c d e f", "a b\nc d e f g", "one two", "One  two", "two one"]
    for size, edits in ((60, 4), (12, 2), (5, 1)):
        texts += family(rng, [f"w{rng.randrange(10**6)}" for _ in range(90)], size, edits)
    shared = [f"s{i}" for i in range(60)]
    texts += [" ".join(shared + [f"u{k}-{i}" for i in range(60)]) for k in range(20)]
    ids = list(range(100, 100 + len(texts)))
    ids[3] = None
    rows = list(zip(ids, texts, strict=True))
    docs = make_docs(texts, ids)
    want = brute(rows)
    assert got(jaccard.jaccard_classes(docs)) == want
    # Small blocks send the same families through several tiles.
    monkeypatch.setattr(jaccard, "PREFIX_BLOCK", 7)
    monkeypatch.setattr(jaccard, "FAMILY_BLOCK", 9)
    monkeypatch.setattr(jaccard, "ROWS_PER_TASK", 20)
    assert got(jaccard.jaccard_classes(docs)) == want
    classes = jaccard.jaccard_classes(docs)
    kept = jaccard.one_per_class(docs, classes)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for i, c, _ in want if c is not None})


def test_empty_and_repeated(make_docs):
    assert got(jaccard.jaccard_classes(make_docs([]))) == []
    assert got(jaccard.jaccard_classes(make_docs(["x y z"] * 3, [4, 4, 9]))) == [(4, 4, 2), (4, 4, 2), (9, 4, 2)]
    assert jaccard.one_per_class(make_docs(["x y z"] * 3, [4, 4, 9]), jaccard.jaccard_classes(make_docs(["x y z"] * 3, [4, 4, 9]))).count() == 1


def test_components(spark):
    edges = [(bytes([i]), bytes([i + 1])) for i in range(60)] + [(b"z1", b"z2"), (b"z2", b"z1"), (b"y", b"y")]
    found = {bytes(r.node): bytes(r.label) for r in connected_components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert all(found[bytes([i])] == bytes([0]) for i in range(61)) and found[b"z2"] == b"z1"


def test_common_counts_by_either_way():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 6000)).astype(np.uint64)) for _ in range(12)]
    a, b = np.arange(5, 12), np.arange(12)
    found = jaccard.common_counts(sets, a, b)
    # A set's count with itself is not asked for.
    assert all(found[x, j] == len(np.intersect1d(sets[i], sets[j])) for x, i in enumerate(a) for j in b if i != j)


def test_prefix_length_reaches_the_recall():
    k = jaccard.prefix_length()
    assert 1 - (1 - 0.8**k) ** jaccard.TREES >= jaccard.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** jaccard.TREES


def test_one_per_class_where_keys_repeat_or_are_missing(make_docs):
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    rows = [(1, x), (2, y), (2, x), (None, x), (3, z), (3, "other words " + y[::-1]), (None, "n " + z[::-1]), (None, "n " + z[::-1]), (None, ""), (None, "")]
    docs = make_docs([t for _, t in rows], [i for i, _ in rows])
    kept = sorted(((r.doc_id, r.text) for r in jaccard.one_per_class(docs, jaccard.jaccard_classes(docs)).collect()), key=str)
    assert kept == sorted([(1, x), (2, y), (3, z), rows[5], rows[6], (None, ""), (None, "")], key=str)


def test_filter_of_families_keeps_all_of_them(spark):
    nodes = [(i, bytes(np.random.default_rng(i).integers(0, 256, 16, dtype=np.uint8))) for i in range(400)]
    df = spark.createDataFrame(nodes, "n int, node binary")
    members = df.where("n % 5 = 0")
    kept = {r.n for r in jaccard.with_families(df, members).collect()}
    assert {n for n, _ in nodes if n % 5 == 0} == kept
    # A filter that is far too small lets others pass as well, one of no members none.
    small = {r.n for r in jaccard.with_families(df, members, 64).collect()}
    assert kept < small and jaccard.with_families(df, members.where("n < 0")).count() == 0


def test_subtrees_join_what_all_pairs_join():
    rng = np.random.default_rng(8)
    trees, k, agreement = 4, 2, 0.5
    for n in (2, 3, 40):
        for sided in (False, True):
            centre = rng.integers(0, 3, (1, trees * jaccard.DEPTH)).astype(np.uint16)
            whole = np.where(rng.random((n, trees * jaccard.DEPTH)) < 0.45, rng.integers(0, 60, (n, trees * jaccard.DEPTH)), centre).astype(np.uint16)
            whole[:, : k] = centre[:, : k]
            side = rng.random(n) < 0.5 if sided else None
            found = jaccard.subtree_families(whole[:, : jaccard.DEPTH], whole, side, k, agreement)
            up = jaccard.Forest(n)
            for i in range(n):
                for j in range(i):
                    if (side is None or side[i] != side[j]) and (whole[i] == whole[j]).mean() >= agreement:
                        up.join(i, j)
            roots = [up.root(i) for i in range(n)]
            assert all((found[i] == found[j]) == (roots[i] == roots[j]) for i in range(n) for j in range(n))


def test_recall_of_links_on_a_larger_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts = sorted({t for _, t in rows if t and t.split()})
    sets = [shingle_set(t) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = Counter((i, j) for docs in holders.values() for n, j in enumerate(docs) for i in docs[:n])
    links = [(i, j) for (i, j), n in common.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9]
    found = {r.doc_id: r.class_id for r in QUERIES["op3_jaccard"](spark, "/root/testdata/sf0.01").collect()}
    ids = {t: i for i, t in rows}
    together = sum(found[ids[texts[i]]] == found[ids[texts[j]]] for i, j in links)
    assert len(found) == len(rows) and links and together >= 0.9999 * len(links)
