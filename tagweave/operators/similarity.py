"""Vector similarity of tags: close pairs, nearest canonical tag, average-linkage clusters.

Vectors meet in blocks of bounded size. A task multiplies two blocks with numpy and returns only the pairs that
pass, so no task holds a whole category and no failing pair is ever written out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

from tagweave.operators.layout import durable, seeded_hash

BLOCK_ROWS = 1000
MAX_PIVOTS = 256
LOCAL_GROUP_ROWS = 2000
# Blocks of a larger table: so many at most, until one holds that many components. Every row goes to each block that it is compared with, so
# a fixed size of blocks would make the copies of a table grow with its square.
MAX_BLOCKS, BLOCK_COMPONENTS = 16, 1 << 21
# Rows of a block that are multiplied at once.
TILE_ROWS = 2048
# Components of clusters that one task goes on merging when no more are left in a group. Rounds over Spark merge one pair each in a chain.
FINISH_COMPONENTS = 1 << 21


def rows_per_block(n_rows: int, width: int, block_rows: int) -> int:
    """Rows of ``width`` components in a block: ``block_rows``, more for a table of more than ``MAX_BLOCKS`` of these."""
    return max(block_rows, min(math.ceil(n_rows / MAX_BLOCKS), BLOCK_COMPONENTS // max(1, width)))


def _as_matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of double components, from lists or from their bytes."""
    if isinstance(vectors.iat[0], bytes | bytearray | memoryview):
        return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _unit(vectors: pd.Series) -> np.ndarray:
    return _unit_rows(_as_matrix(vectors))


@F.pandas_udf(ArrayType(DoubleType()))
def unit_vector(vectors: pd.Series) -> pd.Series:
    """L2-normalised vectors; a zero vector stays zero."""
    return pd.Series(list(_unit(vectors)))


@F.pandas_udf(BinaryType())
def mean_bytes(sums: pd.Series, sizes: pd.Series) -> pd.Series:
    """Bytes of the mean vectors: rows that go to many tasks cost less so than component by component."""
    means = np.stack(sums.to_numpy()).astype(np.float64) / sizes.to_numpy(np.float64)[:, None]
    return pd.Series([m.tobytes() for m in means])


# An encoder factory runs once per task and returns a function from a list of texts to their vectors.
EncoderFactory = Callable[[], Callable[[list[str]], Iterable[Sequence[float]]]]


def embed_tags(
    df: DataFrame, encoder: EncoderFactory, column: str = "tag", vector: str = "vector", batch_size: int = 32
) -> DataFrame:
    """Add ``vector`` by encoding every distinct text of ``column`` once, ``batch_size`` texts per call."""
    texts = df.select(F.col(column).alias("_text")).where(F.col("_text").isNotNull()).distinct()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = encoder()
        for batch in batches:
            items = batch["_text"].tolist()
            vectors: list[list[float]] = []
            for start in range(0, len(items), batch_size):
                vectors += [[float(x) for x in v] for v in run(items[start : start + batch_size])]
            yield pd.DataFrame({"_text": items, vector: vectors})

    # Stored: an encoder call is expensive and must not be repeated by later uses of the table.
    encoded = durable(texts.mapInPandas(encode, f"_text string, {vector} array<float>"))
    return df.join(encoded, F.col(column) == F.col("_text"), "left").drop("_text")


def _pivots(rows: DataFrame, id_col: str, n_rows: int, block_rows: int) -> np.ndarray:
    """Seeded sample of vectors that cut the space into cells: at most ``MAX_PIVOTS`` rows reach the driver."""
    n = max(1, min(MAX_PIVOTS, math.ceil(n_rows / max(block_rows, BLOCK_ROWS))))
    sample = rows.select("_v", seeded_hash(7, id_col).alias("_h")).orderBy("_h").limit(n).collect()
    return _unit(pd.Series([r["_v"] for r in sample])) if sample else np.zeros(0)


def _nearest_pivots(units: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest pivot, angle to it) of every row."""
    sims = units @ pivots.T
    cell = sims.argmax(axis=1)
    return cell.astype("int32"), np.arccos(np.clip(sims[np.arange(len(sims)), cell], -1.0, 1.0))


def _assign_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot ``_cell`` and the angle ``_angle`` to it."""

    @F.pandas_udf("cell int, angle double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        cell, angle = _nearest_pivots(np.stack(vectors.to_numpy()), pivots)
        return pd.DataFrame({"cell": cell, "angle": angle})

    out = rows.withColumn("_n", nearest("_v"))
    return out.withColumns({"_cell": F.col("_n.cell"), "_angle": F.col("_n.angle")}).drop("_n")


def similar_tag_pairs(
    df: DataFrame,
    threshold: float,
    id_col: str = "tag_id",
    group: str = "good_type",
    vector: str = "vector",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All pairs (group, id_a < id_b, cosine) of one group with cosine strictly above ``threshold`` (>= 0).

    Vectors are cut into cells around pivots and cells into blocks of about ``block_rows``. Two blocks are
    compared unless the angle between their pivots minus both radii exceeds arccos(threshold): by the triangle
    inequality of angles no pair between them can pass. The result is exact.
    """
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    rows = df.select(
        F.col(group).alias("_g"), F.col(id_col).alias("_id"), unit_vector(vector).alias("_v")
    ).where(F.col(vector).isNotNull())
    id_type = df.schema[id_col].dataType.simpleString()
    group_type = df.schema[group].dataType.simpleString()
    n_rows, width = df.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    if n_rows == 0:
        return df.sparkSession.createDataFrame(
            [], f"{group} {group_type}, id_a {id_type}, id_b {id_type}, cosine double"
        )
    block_rows = rows_per_block(n_rows, width or 1, block_rows)
    pivots = _pivots(rows, "_id", n_rows, block_rows)
    celled = _assign_cells(rows, pivots)
    cells = celled.groupBy("_g", "_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("_blocks"))
    # Written once: both sides of the comparison and the block table must see the same blocks.
    placed = durable(
        celled.join(cells, ["_g", "_cell"]).withColumn(
            "_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int")
        ).drop("_blocks")
    )
    blocks = placed.groupBy("_g", "_cell", "_block").agg(F.max("_angle").alias("_radius"))
    pairs = _block_pairs(df, blocks, pivots, threshold)

    def side(cell: str, block: str) -> DataFrame:
        rename = {"_cell": cell, "_block": block}
        v = placed.drop("_angle").withColumnsRenamed(rename).join(pairs, ["_g", cell, block])
        # New column identities: both sides of the cogroup come from the same table.
        return v.select(*[F.col(c).alias(c) for c in ("_g", "_ca", "_ba", "_cb", "_bb", "_id", "_v")])

    keys = ["_g", "_ca", "_ba", "_cb", "_bb"]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        u, v = np.stack(left["_v"].to_numpy()), np.stack(right["_v"].to_numpy())
        found = []
        for x in range(0, len(u), TILE_ROWS):
            for y in range(0, len(v), TILE_ROWS):
                sims = u[x : x + TILE_ROWS] @ v[y : y + TILE_ROWS].T
                i, j = np.nonzero(sims > threshold)
                found.append((i + x, j + y, sims[i, j]))
        i, j, cosine = (np.concatenate(c) for c in zip(*found, strict=True))
        a, b = left["_id"].to_numpy()[i], right["_id"].to_numpy()[j]
        same = bool((left["_ca"].iat[0] == left["_cb"].iat[0]) and (left["_ba"].iat[0] == left["_bb"].iat[0]))
        keep = a < b if same else np.ones(len(a), dtype=bool)
        low, high = np.where(a < b, a, b)[keep], np.where(a < b, b, a)[keep]
        return pd.DataFrame(
            {group: left["_g"].iat[0], "id_a": low, "id_b": high, "cosine": cosine[keep]}
        )

    left, right = side("_ca", "_ba").groupBy(*keys), side("_cb", "_bb").groupBy(*keys)
    return left.cogroup(right).applyInPandas(
        compare, f"{group} {group_type}, id_a {id_type}, id_b {id_type}, cosine double"
    )


def _block_pairs(df: DataFrame, blocks: DataFrame, pivots: np.ndarray, threshold: float) -> DataFrame:
    """Pairs of blocks (a <= b) of one group that may hold a passing pair."""
    angles = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
    a, b = np.triu_indices(len(pivots))
    cell_pairs = df.sparkSession.createDataFrame(
        [(int(i), int(j), float(angles[i, j])) for i, j in zip(a, b)], "_ca int, _cb int, _between double"
    )
    left = blocks.withColumnsRenamed({"_cell": "_ca", "_block": "_ba", "_radius": "_ra"})
    right = blocks.withColumnsRenamed({"_cell": "_cb", "_block": "_bb", "_radius": "_rb"})
    slack = math.acos(min(1.0, threshold)) + 1e-7
    near = left.join(cell_pairs, "_ca")
    cond = (
        (near["_g"] == right["_g"])
        & (near["_cb"] == right["_cb"])
        & (F.col("_between") <= F.col("_ra") + F.col("_rb") + F.lit(slack))
        & ((F.col("_ca") < near["_cb"]) | (F.col("_ba") <= F.col("_bb")))
    )
    return near.join(right, cond).select(near["_g"], "_ca", "_ba", near["_cb"], "_bb")


def _top_matches(raw: pd.DataFrame, names: np.ndarray, matrix: np.ndarray, threshold: float, top_k: int) -> pd.DataFrame:
    """The best ``top_k`` canonical rows per raw row that reach ``threshold``; ties to the earlier canonical."""
    sims = _unit(raw["_v"]) @ matrix.T
    k = min(top_k, sims.shape[1])
    best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    score = np.take_along_axis(sims, best, axis=1)
    i, j = np.nonzero(score >= threshold)
    return pd.DataFrame({"raw_id": raw["_id"].to_numpy()[i], "canonical_id": names[best[i, j]], "cosine": score[i, j]})


def map_to_canonical(
    raw: DataFrame,
    canonical: DataFrame,
    threshold: float = 0.65,
    top_k: int = 1,
    id_col: str = "tag_id",
    vector: str = "vector",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(raw_id, canonical_id, cosine, rank): the nearest canonical tags per raw tag at or above ``threshold``.

    A canonical list of up to ``block_rows`` rows (counted first) travels with the tasks and the raw table is not
    shuffled. A longer list is cut into blocks; every raw block meets every canonical block, keeps its best
    ``top_k``, and the partial winners are ranked per raw tag.
    """
    raw_type = raw.schema[id_col].dataType.simpleString()
    canon_type = canonical.schema[id_col].dataType.simpleString()
    schema = f"raw_id {raw_type}, canonical_id {canon_type}, cosine double"
    left = raw.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"))
    right = canonical.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"))
    n = right.count()
    if n == 0:
        found = raw.sparkSession.createDataFrame([], schema)
    elif n <= block_rows:
        names, matrix = _canonical_arrays(right.toPandas())

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield _top_matches(batch, names, matrix, threshold, top_k)

        found = left.mapInPandas(scan, schema)
    else:
        found = _blocked_matches(left, right, n, threshold, top_k, block_rows, schema)
    rank = F.row_number().over(W.partitionBy("raw_id").orderBy(F.col("cosine").desc(), "canonical_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top_k)


def _canonical_arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("_id")
    return pdf["_id"].to_numpy(), _unit(pdf["_v"])


def _blocked_matches(
    left: DataFrame, right: DataFrame, n: int, threshold: float, top_k: int, block_rows: int, schema: str
) -> DataFrame:
    n_right = math.ceil(n / block_rows)
    n_left = max(1, math.ceil(left.count() / (5 * block_rows)))

    def block(of: int) -> Column:
        return F.pmod(F.xxhash64("_id"), F.lit(of)).cast("int")

    def every(of: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(of - 1)))

    a = left.withColumn("_a", block(n_left)).withColumn("_b", every(n_right))
    b = right.withColumn("_b", block(n_right)).withColumn("_a", every(n_left))

    def compare(rows: pd.DataFrame, canon: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or canon.empty:
            return pd.DataFrame({"raw_id": [], "canonical_id": [], "cosine": []})
        return _top_matches(rows, *_canonical_arrays(canon), threshold, top_k)

    return a.groupBy("_a", "_b").cogroup(b.groupBy("_a", "_b")).applyInPandas(compare, schema)


# -- average linkage ------------------------------------------------------------------------------------------
#
# For unit vectors the mean cosine between two clusters is the inner product of their vector sums over the product
# of their sizes. Average linkage is reducible: merging every pair of clusters that are each other's nearest
# neighbour gives the same clusters as merging one best pair at a time, in few rounds.


class _Vectors:
    """Rows in double and single precision, and the length of the longest."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.low = rows.astype(np.float32)
        self.longest = float(np.sqrt(np.einsum("ij,ij->i", rows, rows).max(initial=0.0)))


Best = tuple[np.ndarray, np.ndarray]  # score of every row and the row it belongs to


def _no_best(n: int) -> Best:
    return np.full(n, -np.inf), np.zeros(n, np.int64)


def _exact(m: np.ndarray, i: np.ndarray, o: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, the same whichever side a row stands on."""
    step = 1 << 15
    return np.concatenate([np.zeros(0), *((m[i[x : x + step]] * o[j[x : x + step]]).sum(axis=1) for x in range(0, len(i), step))])


def _scan(
    own: _Vectors, other: _Vectors, threshold: float, first: Best, second: Best | None, tile_rows: int,
    same: bool = False, selves: np.ndarray | None = None,
) -> None:
    """Update the best of ``own`` rows (``first``) and of ``other`` rows (``second``) with what is above ``threshold`` in the other table.

    Tiles are multiplied in single precision; only pairs that rounding leaves open are computed in double. Equal scores go to the
    earlier row. With ``same`` both tables are one; ``selves`` are the places of ``own`` rows in ``other``, no row meets itself.
    """
    m, o = own.rows, other.rows
    slack = (m.shape[1] + 8) * 2.0**-24 * own.longest * other.longest
    # Written over by every tile.
    space = np.empty((min(tile_rows, len(m)), min(tile_rows, len(o))), np.float32)
    for x in range(0, len(m), tile_rows):
        for y in range(x if same else 0, len(o), tile_rows):
            left, right = own.low[x : x + tile_rows], other.low[y : y + tile_rows]
            sims = np.matmul(left, right.T, out=space[: len(left), : len(right)])
            at = None
            if same and x == y:
                at = np.arange(len(left)), np.arange(len(left))
            elif selves is not None:
                here = np.flatnonzero((selves[x : x + tile_rows] >= y) & (selves[x : x + tile_rows] < y + len(right)))
                at = here, selves[x + here] - y
            if at is not None:
                sims[at] = -np.inf
            mirrored = first if same else second
            sides = [(0, first, x, y, sims)]
            if mirrored is not None and not (same and x == y):
                sides.append((1, mirrored, y, x, sims.T))
            found = []
            for side, best, a, b, s in sides:
                top = sims.max(axis=1 - side)
                rows = np.flatnonzero(top >= np.maximum(best[0][a : a + len(s)], threshold) - slack)
                i, j = np.nonzero(s[rows] >= (top[rows] - 2 * slack)[:, None])
                found.append((side, best, a, b, rows, i, j))
            # Of very many open pairs, as rows that are nearly equal give, all are computed at once.
            full = None
            if sum(len(f[5]) for f in found) > 16 * (len(left) + len(right)):
                full = m[x : x + tile_rows] @ o[y : y + tile_rows].T
                if same and x == y:
                    full = (full + full.T) / 2
                if at is not None:
                    full[at] = -np.inf
            for side, best, a, b, rows, i, j in found:
                if not len(rows):
                    continue
                if full is not None:
                    s = (full.T if side else full)[rows]
                    j = s.argmax(axis=1)
                    score = s[np.arange(len(rows)), j]
                else:
                    score = _exact(m if side == 0 else o, a + rows[i], o if side == 0 else m, b + j)
                    order = np.lexsort((j, -score, i))
                    lead = order[np.searchsorted(i, np.arange(len(rows)))]
                    score, j = score[lead], j[lead]
                # Tiles come in the order of rows, so the first of equal ones stays.
                better = score > np.maximum(best[0][a + rows], threshold)
                best[0][a + rows[better]], best[1][a + rows[better]] = score[better], b + j[better]


def _merge_rounds(sums: np.ndarray, threshold: float, sizes: np.ndarray | None = None, tile_rows: int = TILE_ROWS) -> np.ndarray:
    """Cluster index per row (the smallest row of the cluster) for one bounded group of vector sums, of single vectors without ``sizes``.

    A merged cluster is no nearer to another one than the nearer of its parts was. So a cluster keeps its nearest one until that merges,
    one without a close one never gets any, and only merged clusters and those whose nearest one merged are looked up again.
    """
    owner, heads = np.arange(len(sums)), np.arange(len(sums))
    if len(sums) < 2:
        return owner
    sums, sizes = sums.astype(np.float64), np.ones(len(sums)) if sizes is None else sizes.astype(np.float64)
    v = _Vectors(sums / sizes[:, None])
    best = _no_best(len(sums))
    _scan(v, v, threshold, best, None, tile_rows, same=True)
    fresh = True
    while True:
        at = np.flatnonzero(best[0] > threshold)
        if 2 * len(at) < len(best[0]):
            place = np.full(len(best[0]), -1)
            place[at] = np.arange(len(at))
            sums, sizes, heads, best = sums[at], sizes[at], heads[at], (best[0][at], place[best[1][at]])
            v = _Vectors(v.rows[at])
            at = np.arange(len(at))
        if not len(at):
            break
        mutual = at[(best[1][best[1][at]] == at) & (best[0][best[1][at]] > threshold) & (at < best[1][at])]
        if not len(mutual):
            if fresh:
                break
            # Equal similarities may leave no mutual pair among those that were kept.
            dirty, fresh = at, True
        else:
            into, gone = mutual, best[1][mutual]
            sums[into] += sums[gone]
            sizes[into] += sizes[gone]
            owner[heads[gone]] = heads[into]
            # Zeros are close to nothing.
            v.rows[into], v.rows[gone] = sums[into] / sizes[into][:, None], 0.0
            v.low[into], v.low[gone] = v.rows[into], 0.0
            best[0][gone] = -np.inf
            changed = np.zeros(len(best[0]), bool)
            changed[into] = changed[gone] = True
            dirty = at[(changed[at] | changed[best[1][at]]) & (best[0][at] > threshold)]
            fresh = len(dirty) == np.count_nonzero(best[0] > threshold)
        # Those without a close one have dropped out, and what has dropped out is close to nothing.
        own, found = _Vectors(v.rows[dirty]), _no_best(len(dirty))
        _scan(own, v, threshold, found, None, tile_rows, selves=dirty)
        best[0][dirty], best[1][dirty] = found
    # Heads are the smallest rows of their clusters, so each step leads to a smaller row.
    while not (owner[owner] == owner).all():
        owner = owner[owner]
    return owner


def cluster_tags(
    df: DataFrame,
    threshold: float = 0.91,
    id_col: str = "tag_id",
    group: str = "good_type",
    vector: str = "vector",
    local_rows: int = LOCAL_GROUP_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(group, id, cluster_id): average-linkage clusters on cosine, merged while the mean cosine is above
    ``threshold``; ``cluster_id`` is the smallest id of the cluster.

    A group of up to ``local_rows`` tags (counted first) is clustered inside one task. Larger groups run the same merges as Spark rounds
    until no more than ``local_rows`` of their clusters, or than hold ``FINISH_COMPONENTS`` components, have a close one, so their size is not
    limited; see :func:`nearest_clusters`.
    """
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    group_type = df.schema[group].dataType.simpleString()
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"{group} {group_type}, {id_col} {id_type}, cluster_id {id_type}"
    rows = df.where(F.col(vector).isNotNull()).select(group, id_col, vector)
    large = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > local_rows).select(group)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        ids = pdf[id_col].to_numpy()
        owner = _merge_rounds(_unit(pdf[vector]), threshold)
        return pd.DataFrame({group: pdf[group].to_numpy(), id_col: ids, "cluster_id": ids[owner]})

    if large.limit(1).count() == 0:
        return rows.groupBy(group).applyInPandas(local, schema)
    small = rows.join(large, group, "left_anti").groupBy(group).applyInPandas(local, schema)
    big = rows.join(large, group, "left_semi")
    return small.unionByName(_cluster_rounds(big, threshold, id_col, group, vector, local_rows, block_rows))


def collapse_copies(
    rows: DataFrame, threshold: float, id_col: str, group: str, vector: str
) -> tuple[DataFrame, DataFrame]:
    """Equal vectors of a group as one row (_g, _c = smallest id, _v unit vector, _n copies), and (_g, _id, _c).

    Copies have cosine 1 and merge before anything else, so they can start as one cluster; without this a large
    group of copies would give a quadratic number of pairs. Counting copies combines before the shuffle.
    """
    units = durable(rows.select(F.col(group).alias("_g"), F.col(id_col).alias("_id"), unit_vector(vector).alias("_v")))
    if threshold >= 1:
        return units.select("_g", F.col("_id").alias("_c"), "_v", F.lit(1).alias("_n")), units.withColumn("_c", F.col("_id"))
    # A zero vector has cosine 0 to everything, its copies among them, so it stands for itself alone.
    units = units.withColumn("_own", F.when(~F.exists("_v", lambda x: x != 0), F.col("_id")))
    reps = units.groupBy("_g", "_v", "_own").agg(F.min("_id").alias("_c"), F.count(F.lit(1)).alias("_n"))
    copies = reps.select(F.col("_g").alias("_g2"), F.col("_v").alias("_v2"), F.col("_own").alias("_own2"), "_c")
    same = (F.col("_g") == F.col("_g2")) & (F.col("_v") == F.col("_v2")) & F.col("_own").eqNullSafe(F.col("_own2"))
    return reps.drop("_own"), units.join(copies, same).select("_g", "_id", "_v", "_c")


def nearest_of_blocks(left: pd.DataFrame, right: pd.DataFrame, threshold: float, tile_rows: int = TILE_ROWS) -> pd.DataFrame:
    """(_g, _c, _o, _sim): for every row of two blocks, which may be the same one, its nearest in the other block above ``threshold``."""
    left, right = left.sort_values("_id"), right.sort_values("_id")
    same = bool((left["_ca"].iat[0] == left["_cb"].iat[0]) and (left["_ba"].iat[0] == left["_bb"].iat[0]))
    m = _Vectors(_as_matrix(left["_m"]))
    o = m if same else _Vectors(_as_matrix(right["_m"]))
    first, second = _no_best(len(left)), None if same else _no_best(len(right))
    # A pair has one similarity for both its rows, so the best pair of all is mutual.
    _scan(m, o, threshold, first, second, tile_rows, same=same)
    out = []
    for own, other, (score, at) in ((left, right, first), *(() if same else ((right, left, second),))):
        kept = score > threshold
        out.append(pd.DataFrame({"_g": left["_g"].iat[0], "_c": own["_id"].to_numpy()[kept], "_o": other["_id"].to_numpy()[at[kept]], "_sim": score[kept]}))
    return pd.concat(out)


def nearest_clusters(clusters: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(_g, _c, _o, _sim): the nearest other cluster of each one that has any with a mean cosine above ``threshold``; ties to the smaller id.

    ``clusters`` has the vector sum ``_s`` and size ``_n`` of each (_g, _c). The mean cosine of two is the inner product of their mean
    vectors. These are cut into cells around pivots and blocks; of two blocks none can be near if the lengths of their longest means times the
    cosine of the smallest angle between them, by the triangle inequality, do not pass. A pair of blocks gives one row per
    cluster at most, so a dense group never writes its pairs.
    """
    kinds = {c: clusters.schema[c].dataType.simpleString() for c in ("_g", "_c")}
    schema = f"_g {kinds['_g']}, _c {kinds['_c']}, _o {kinds['_c']}, _sim double"
    rows = clusters.select("_g", F.col("_c").alias("_id"), mean_bytes("_s", "_n").alias("_m"))
    n_rows, width = clusters.agg(F.count(F.lit(1)), F.max(F.size("_s"))).first()
    if not n_rows:
        return clusters.sparkSession.createDataFrame([], schema)
    block_rows = rows_per_block(n_rows, width or 1, block_rows)
    pivots = _pivots(rows.select("_id", F.col("_m").alias("_v")), "_id", n_rows, block_rows)

    @F.pandas_udf("cell int, angle double, reach double")
    def place(means: pd.Series) -> pd.DataFrame:
        m = _as_matrix(means)
        cell, angle = _nearest_pivots(_unit_rows(m), pivots)
        return pd.DataFrame({"cell": cell, "angle": angle, "reach": np.linalg.norm(m, axis=1)})

    celled = rows.withColumn("_p", place("_m")).select("_g", "_id", "_m", F.col("_p.cell").alias("_cell"), F.col("_p.angle").alias("_angle"), F.col("_p.reach").alias("_reach"))
    cells = celled.groupBy("_g", "_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("_blocks"))
    block = F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int")
    placed = durable(celled.join(cells, ["_g", "_cell"]).withColumn("_block", block).drop("_blocks"))
    blocks = placed.groupBy("_g", "_cell", "_block").agg(F.max("_angle").alias("_radius"), F.max("_reach").alias("_far"))
    angles = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
    a, b = np.triu_indices(len(pivots))
    between = clusters.sparkSession.createDataFrame([(int(i), int(j), float(angles[i, j])) for i, j in zip(a, b)], "_ca int, _cb int, _between double")
    left = blocks.withColumnsRenamed({"_cell": "_ca", "_block": "_ba", "_radius": "_ra", "_far": "_fa"}).join(between, "_ca")
    right = blocks.select(F.col("_g").alias("_g2"), F.col("_cell").alias("_c2"), F.col("_block").alias("_bb"), F.col("_radius").alias("_rb"), F.col("_far").alias("_fb"))
    most = F.col("_fa") * F.col("_fb") * F.cos(F.greatest(F.lit(0.0), F.col("_between") - F.col("_ra") - F.col("_rb") - F.lit(1e-7)))
    near = (F.col("_g") == F.col("_g2")) & (F.col("_cb") == F.col("_c2")) & (most > threshold - 1e-9) & ((F.col("_ca") < F.col("_cb")) | (F.col("_ba") <= F.col("_bb")))
    pairs = left.join(right, near).select("_g", "_ca", "_ba", "_cb", "_bb")
    keys = ["_g", "_ca", "_ba", "_cb", "_bb"]

    def side(cell: str, block: str) -> DataFrame:
        v = placed.select("_g", "_id", "_m", F.col("_cell").alias(cell), F.col("_block").alias(block)).join(pairs, ["_g", cell, block])
        return v.select(*[F.col(c).alias(c) for c in (*keys, "_id", "_m")])

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return nearest_of_blocks(left, right, threshold)

    found = side("_ca", "_ba").groupBy(*keys).cogroup(side("_cb", "_bb").groupBy(*keys)).applyInPandas(compare, schema)
    best = F.min(F.struct((-F.col("_sim")).alias("s"), F.col("_o").alias("o"))).alias("_b")
    return found.groupBy("_g", "_c").agg(best).select("_g", "_c", F.col("_b.o").alias("_o"), (-F.col("_b.s")).alias("_sim"))


def _cluster_rounds(
    rows: DataFrame, threshold: float, id_col: str, group: str, vector: str, local_rows: int, block_rows: int
) -> DataFrame:
    """Rounds that merge all clusters that are each other's nearest. A cluster without a close one never gets one, as a mean of low
    cosines is low, and drops out; where few are left in a group, one task ends its merges."""
    reps, owner = collapse_copies(rows, threshold, id_col, group, vector)
    sums = F.transform("_v", lambda x: x * F.col("_n")).alias("_s")
    clusters = durable(reps.select("_g", "_c", sums, F.col("_n").cast("long").alias("_n")))
    owner = owner.select("_g", "_id", "_c")
    types = {c: clusters.schema[c].dataType.simpleString() for c in ("_g", "_c")}
    width = clusters.agg(F.max(F.size("_s"))).first()[0] or 1
    last_rows = max(local_rows, FINISH_COMPONENTS // max(1, width))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_c")
        ids = pdf["_c"].to_numpy()
        into = ids[_merge_rounds(np.stack(pdf["_s"].to_numpy()), threshold, pdf["_n"].to_numpy())]
        moved = into != ids
        return pd.DataFrame({"_g": pdf["_g"].to_numpy()[moved], "_gone": ids[moved], "_into": into[moved]})

    while True:
        best = durable(nearest_clusters(clusters, threshold, block_rows))
        left = durable(best.groupBy("_g").agg(F.count(F.lit(1)).alias("_left")))
        active = clusters.join(best.select("_g", "_c"), ["_g", "_c"], "left_semi")
        few = left.where(F.col("_left") <= last_rows).select("_g")
        ended = active.join(few, "_g", "left_semi").groupBy("_g").applyInPandas(finish, f"_g {types['_g']}, _gone {types['_c']}, _into {types['_c']}")
        many = best.join(left.where(F.col("_left") > last_rows).select("_g"), "_g", "left_semi")
        back = many.select("_g", F.col("_o").alias("_c"), F.col("_c").alias("_o"))
        mutual = many.join(back, ["_g", "_c", "_o"]).where(F.col("_c") < F.col("_o")).select("_g", F.col("_o").alias("_gone"), F.col("_c").alias("_into"))
        merges = durable(ended.unionByName(mutual))
        moved = merges.select("_g", F.col("_gone").alias("_c"), "_into")
        owner = durable(owner.join(moved, ["_g", "_c"], "left").withColumn("_c", F.coalesce("_into", "_c")).drop("_into"))
        if not left.where(F.col("_left") > last_rows).limit(1).count():
            break
        still = active.join(left.where(F.col("_left") > last_rows).select("_g"), "_g", "left_semi")
        gone = still.join(moved, ["_g", "_c"]).select("_g", F.col("_into").alias("_c"), F.col("_s").alias("_s2"), F.col("_n").alias("_n2"))
        both = F.when(F.col("_s2").isNull(), F.col("_s")).otherwise(F.zip_with("_s", "_s2", lambda x, y: x + y)).alias("_s")
        kept = still.join(moved.select("_g", "_c"), ["_g", "_c"], "left_anti").join(gone, ["_g", "_c"], "left")
        clusters = durable(kept.select("_g", "_c", both, (F.col("_n") + F.coalesce("_n2", F.lit(0))).alias("_n")))
    return owner.select(F.col("_g").alias(group), F.col("_id").alias(id_col), F.col("_c").alias("cluster_id"))
