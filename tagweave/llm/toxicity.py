"""Toxicity: a small convolutional text classifier in numpy, with a threshold per language, learnt as groups of like character trigrams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.classifiers import keep_rows, labelled_keys, pack_arrays, score_texts, unpack_arrays
from tagweave.llm.common import arrow_map, byte_table, stored, text_slices, word_hashes
from tagweave.llm.jaccard import with_families

BUCKET_BITS = 16
# A word's vector is the sum of this many hashed vectors, so that two words rarely share all of them.
HASHES = 2
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 4
# Labelled documents that one task learns from; their number decides how many shards there are, never how many documents take part.
SHARD_DOCS = 5000
EPOCHS, BATCH, RATE = 14, 16, 0.1
# Passes over several shards, with the shards' models put together behind each; every pass has more steps than one over a single shard.
ROUNDS = 8
# Ranges of the embedding table that are put together in tasks of their own.
PARTS = 16
# Steps of a score's logit that are told apart when cuts are set over several shards.
CUT_STEPS = 256
# The score at which a text counts as toxic, for every language: scores are shifted so that each language's own cut lies there.
CUT = 0.3
# Rows of a language and class below which its cut is the one of all languages together.
MIN_CALIBRATION = 15

# Languages are groups of texts with similar character trigrams, learnt without labels; trigrams are hashed to PROFILE buckets.
LANGUAGES, PROFILE, GROUP_ROUNDS = 6, 512, 12
# What Adagrad begins with.
EPS = np.float32(1e-6)

_PUNCTUATION = bytes(b for b in range(128) if not chr(b).isalnum())
_TABLE = byte_table(_PUNCTUATION)


def _plain(texts: list[str]) -> list[bytes]:
    return [t.lower().encode("utf-8", "surrogatepass").translate(_TABLE) for t in texts]


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-case words without ASCII punctuation, and the number of words per text."""
    return word_hashes(_plain(texts))


def trigrams(texts: list[str]) -> np.ndarray:
    """(texts, PROFILE) counts of hashed byte trigrams of the lower-case text without ASCII punctuation; runs of white space take no part."""
    out = np.zeros((len(texts), PROFILE), np.int64)
    for row, text in enumerate(_plain(texts)):
        for at in range(0, len(text), 1 << 20):
            x = np.frombuffer(text[at : at + (1 << 20) + 2], np.uint8).astype(np.uint32)
            blank = x <= 32
            code = (x[:-2] << 16) + (x[1:-1] << 8) + x[2:]
            code = code[~((blank[:-2] & blank[1:-1]) | (blank[1:-1] & blank[2:]))]
            out[row] += np.bincount((code * np.uint32(2654435761)) >> np.uint32(23), minlength=PROFILE)
    return out


def as_profiles(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares of a row's counts, of length one; zeros for a row without any."""
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def profiles(texts: list[str]) -> np.ndarray:
    """(texts, PROFILE) what a text's language is told by, see :func:`trigrams` and :func:`as_profiles`."""
    return as_profiles(trigrams(texts))


def language_groups(found: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """(groups, PROFILE) centres of at most LANGUAGES groups of profiles, by spherical k-means from seeds that lie apart."""
    found = found[found.any(1)]
    if not len(found):
        return np.zeros((0, PROFILE), np.float32)
    centres = found[rng.integers(len(found))][None]
    while len(centres) < LANGUAGES:
        far = np.maximum(1 - (found @ centres.T).max(1), 0).astype(np.float64) ** 2
        if far.sum() < 1e-9:
            break
        centres = np.concatenate((centres, found[rng.choice(len(found), p=far / far.sum())][None]))
    for _ in range(GROUP_ROUNDS):
        own = (found @ centres.T).argmax(1)
        sums = np.stack([found[own == i].sum(0) if (own == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres.astype(np.float32)


def languages(found: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the group whose centre is nearest to each profile (ties: the first); the number of groups for an empty profile."""
    if not len(centres):
        return np.zeros(len(found), np.int64)
    # Row by row, so that a text's group does not hang on its neighbours in the batch.
    return np.array([int((centres @ x).argmax()) if x.any() else len(centres) for x in found], np.int64)


def buckets(hashes: np.ndarray) -> np.ndarray:
    """(words, HASHES) rows of the embedding table."""
    mask = np.uint64((1 << BUCKET_BITS) - 1)
    return np.stack([((hashes >> np.uint64(20 * i)) & mask).astype(np.int64) for i in range(HASHES)], axis=1)


def pooled(vectors: np.ndarray, counts: np.ndarray, filters: dict[int, np.ndarray], where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Maximum over each text of every filter's response, no less than zero, and the place of each maximum (-1: the zero).

    A filter of width w sees w words in a row of one text; shorter texts give zero.
    """
    ends = np.cumsum(counts)
    out = np.zeros((len(counts), FILTERS * len(WIDTHS)), np.float32)
    places = np.full(out.shape, -1, np.int64) if where else None
    for i, width in enumerate(WIDTHS):
        n = len(vectors) - width + 1
        enough = counts >= width
        if n <= 0 or not enough.any():
            continue
        response = vectors[:n] @ filters[width][0]
        for j in range(1, width):
            response += vectors[j : j + n] @ filters[width][j]
        # Windows that start inside a text but end in the next one are cut off by the bounds of the segments.
        bounds = np.stack([(ends - counts)[enough], (ends - width + 1)[enough]], axis=1).ravel()
        padded = np.concatenate((response, np.full((1, FILTERS), -np.inf, np.float32)))
        best = np.maximum.reduceat(padded, bounds, axis=0)[::2]
        columns = slice(i * FILTERS, (i + 1) * FILTERS)
        out[enough, columns] = np.maximum(best, 0)
        if where:
            for row, (a, b) in zip(np.flatnonzero(enough), bounds.reshape(-1, 2), strict=True):
                at = a + response[a:b].argmax(0)
                places[row, columns] = np.where(best[np.searchsorted(np.flatnonzero(enough), row)] > 0, at, -1)
    return out, places


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def logit(p: np.ndarray | float) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def arrays_at_start(share: float, seed: int) -> tuple[dict[str, np.ndarray], np.random.Generator]:
    """Random embeddings, filters and output weights, and what Adagrad has seen of each (``seen_``: next to nothing)."""
    rng = np.random.default_rng(seed)
    m = {"table": rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)}
    m |= {f"filters_{w}": rng.normal(0, 1 / np.sqrt(w), (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS}
    m["out"] = rng.normal(0.5, 0.2, FILTERS * len(WIDTHS)).astype(np.float32)
    m["bias"] = np.array(logit(share) if 0 < share < 1 else logit(min(max(share, 1e-3), 1 - 1e-3)), np.float32)
    return m | {f"seen_{k}": np.full_like(x, EPS) for k, x in m.items()}, rng


def held_back(labels: np.ndarray) -> np.ndarray:
    """Every fifth document of each class: left out of the gradient steps, sets the cuts."""
    place = np.empty(len(labels), np.int64)
    for c in (0, 1):
        place[labels == c] = np.arange((labels == c).sum())
    return place % 5 == 4


def word_ids(sample: dict[str, np.ndarray]) -> np.ndarray:
    return buckets(sample["words"]) if "words" in sample else sample["ids"]


def profile(sample: dict[str, np.ndarray]) -> np.ndarray:
    return sample.get("profile", np.zeros(PROFILE, np.float32))


def descend(m: dict[str, np.ndarray], ids_of: list[np.ndarray], labels: np.ndarray, learn: np.ndarray, rng: np.random.Generator, epochs: int) -> None:
    """Adagrad on the logistic loss over the documents ``learn``; changes the arrays of ``m``."""
    table, out, filters = m["table"], m["out"], {w: m[f"filters_{w}"] for w in WIDTHS}
    bias, seen_bias = np.float32(m["bias"]), np.float32(m["seen_bias"])
    for _ in range(epochs):
        rng.shuffle(learn)
        for at in range(0, len(learn), BATCH):
            rows = learn[at : at + BATCH]
            ids, counts = np.concatenate([ids_of[i] for i in rows]).astype(np.int64), np.array([len(ids_of[i]) for i in rows])
            # Dropping words at random keeps the filters from learning single documents by heart.
            keep = rng.random(len(ids)) > 0.1
            vectors = table[ids].sum(1) * keep[:, None]
            features, places = pooled(vectors, counts, filters, where=True)
            error = (logistic(features @ out + bias) - labels[rows]).astype(np.float32)
            back = error[:, None] * out
            steps = {"out": error @ features / len(rows) + 1e-4 * out, "bias": error.mean()}
            changed_ids, changed = [], []
            for i, w in enumerate(WIDTHS):
                grad = np.zeros_like(filters[w])
                doc, f = np.nonzero(places[:, i * FILTERS : (i + 1) * FILTERS] >= 0)
                spot = places[doc, i * FILTERS + f]
                pull = back[doc, i * FILTERS + f] / len(rows)
                for j in range(w):
                    np.add.at(grad[j].T, f, pull[:, None] * vectors[spot + j])
                    changed_ids.append(ids[spot + j])
                    changed.append(pull[:, None] * filters[w][j][:, f].T * keep[spot + j][:, None])
                steps[w] = grad + 1e-4 * filters[w]
            for w in WIDTHS:
                m[f"seen_filters_{w}"] += steps[w] ** 2
                filters[w] -= RATE * steps[w] / np.sqrt(m[f"seen_filters_{w}"])
            m["seen_out"] += steps["out"] ** 2
            out -= RATE * steps["out"] / np.sqrt(m["seen_out"])
            seen_bias += steps["bias"] ** 2
            bias -= np.float32(RATE * steps["bias"] / np.sqrt(seen_bias))
            if changed_ids:
                at_rows, which = np.unique(np.concatenate(changed_ids), return_inverse=True)
                grad = np.zeros((len(at_rows), DIMENSIONS), np.float32)
                for h in range(HASHES):
                    np.add.at(grad, which.reshape(-1, HASHES)[:, h], np.concatenate(changed))
                m["seen_table"][at_rows] += grad**2
                table[at_rows] -= RATE * grad / np.sqrt(m["seen_table"][at_rows])
    m["bias"], m["seen_bias"] = np.array(bias), np.array(seen_bias)


def settled(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What scoring needs. Buckets that no step has reached say nothing: they end as zero, so chance words of long texts excite no filter."""
    table = m["table"].copy()
    table[(m["seen_table"] <= EPS).all(1)] = 0
    return {k: x for k, x in m.items() if not k.startswith("seen_")} | {"table": table}


def sample_scores(m: dict[str, np.ndarray], ids_of: list[np.ndarray]) -> np.ndarray:
    filters = {w: m[f"filters_{w}"] for w in WIDTHS}
    return np.array([raw_scores(m["table"], filters, m["out"], m["bias"], x.astype(np.int64), np.array([len(x)]))[0] for x in ids_of], np.float64)


def fit(samples: list[dict[str, np.ndarray]], labels: np.ndarray, seed: int = 11) -> bytes:
    """Embeddings, filters, output weights, centres of languages and a cut for each, from all documents of a single shard.

    Every fifth document of each class is left out of the gradient steps and sets the cuts. Without both classes the score
    is the share of class 1.
    """
    share = labels.mean() if len(labels) else 0.5
    m, rng = arrays_at_start(share, seed)
    found = np.array([profile(s) for s in samples], np.float32).reshape(-1, PROFILE)
    centres = language_groups(found, np.random.default_rng(seed))
    # The last cut is that of texts without a profile.
    cuts = np.full(len(centres) + 1, CUT)
    if 0 < share < 1:
        held = held_back(labels)
        ids_of = [word_ids(s) for s in samples]
        descend(m, ids_of, labels, np.flatnonzero(~held), rng, EPOCHS)
    m = settled(m) if 0 < share < 1 else {k: x for k, x in m.items() if not k.startswith("seen_")}
    if 0 < share < 1:
        at = np.flatnonzero(held)
        cuts = language_cuts(score_counts(sample_scores(m, [ids_of[i] for i in at]), labels[at], languages(found[at], centres)), len(centres))
    return pack_arrays(**m, cuts=cuts, centres=centres)


COUNTS = ("language", "step", "n", "hits", "low", "high")


def score_counts(score: np.ndarray, labels: np.ndarray, language: np.ndarray, steps: int | None = None) -> dict[str, np.ndarray]:
    """Documents and toxic ones by language and score; with ``steps``, by score in steps of its logit, with the least and largest score of each."""
    step = score if steps is None else np.floor(logit(score) * steps)
    keys, which = np.unique(np.stack([language.astype(np.float64), step], axis=1), axis=0, return_inverse=True)
    n, which = len(keys), which.ravel()
    low, high = np.full(n, np.inf), np.full(n, -np.inf)
    np.minimum.at(low, which, score)
    np.maximum.at(high, which, score)
    hits = np.bincount(which, weights=labels, minlength=n).astype(np.int64)
    return {"language": keys[:, 0].astype(np.int64), "step": keys[:, 1], "n": np.bincount(which, minlength=n), "hits": hits, "low": low, "high": high}


def language_cuts(c: dict[str, np.ndarray], groups: int) -> np.ndarray:
    """A cut for each language and one for texts without a profile; a language with few documents of a class has the common one."""
    cuts = np.full(groups + 1, best_cut(c))
    for i in range(groups):
        own = {k: x[c["language"] == i] for k, x in c.items()}
        if min(own["hits"].sum(), (own["n"] - own["hits"]).sum()) >= MIN_CALIBRATION:
            cuts[i] = best_cut(own)
    return cuts


def best_cut(c: dict[str, np.ndarray]) -> float:
    """The cut with the largest F1, in the middle between the scores on its two sides."""
    if not c["hits"].sum():
        return CUT
    step, which = np.unique(-c["step"], return_inverse=True)
    n, hits = (np.cumsum(np.bincount(which, weights=c[k])) for k in ("n", "hits"))
    low, high = np.full(len(step), np.inf), np.full(len(step), -np.inf)
    np.minimum.at(low, which, c["low"])
    np.maximum.at(high, which, c["high"])
    i = int(np.argmax(2 * hits / (n + hits[-1])))
    below = high[i + 1] if i + 1 < len(step) else 0.0
    return float(logistic((logit(low[i]) + logit(below)) / 2)) if below > 0 else float(low[i] / 2)


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict[str, np.ndarray]], np.ndarray]]:
    """(shard, its samples, their labels): rows of a shard lie one behind the other in a file, in the order of their keys."""
    now, samples, labels = None, [], []
    for b in batches:
        for shard, y, ids, counts in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if shard != now and samples:
                yield now, samples, np.array(labels, np.int64)
                samples, labels = [], []
            now = shard
            found = as_profiles(np.frombuffer(counts, f"<u{len(counts) // PROFILE}").astype(np.int64)[None])[0]
            samples.append({"ids": np.frombuffer(ids, "<u2").reshape(-1, HASHES), "profile": found})
            labels.append(y)
    if samples:
        yield now, samples, np.array(labels, np.int64)


def _changes(old: dict[str, np.ndarray], new: dict[str, np.ndarray], sums: dict[str, np.ndarray]) -> None:
    """Add a shard's changes to ``sums``; a bucket's only where the shard has moved it."""
    moved = (new["seen_table"] > old["seen_table"]).any(1)
    sums["movers"] = sums.get("movers", 0) + moved.astype(np.int32)
    for k in old:
        sums[k] = sums.get(k, 0.0) + (new[k].astype(np.float64) - old[k])


def _in_parts(sums: dict[str, np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(part, arrays): the embedding table's moved rows by range, everything else as the last part."""
    size = (1 << BUCKET_BITS) // PARTS
    for part in range(PARTS):
        at = part * size + np.flatnonzero(sums["movers"][part * size : (part + 1) * size])
        if len(at):
            yield part, pack_arrays(at=at, **{k: sums[k][at].astype(np.int32 if k == "movers" else np.float32) for k in ("movers", "table", "seen_table")})
    yield PARTS, pack_arrays(**{k: x for k, x in sums.items() if k not in ("movers", "table", "seen_table")})


def _add_up(rows: pa.Table) -> pa.Table:
    """One row of a part from those of all tasks."""
    part, total = rows.column("part")[0].as_py(), {}
    found = [unpack_arrays(x) for x in rows.column("data").to_pylist()]
    if part == PARTS:
        total = {k: sum(x[k] for x in found) for k in found[0]}
    else:
        at, which = np.unique(np.concatenate([x["at"] for x in found]), return_inverse=True)
        total["at"] = at
        for k in ("movers", "table", "seen_table"):
            total[k] = np.zeros((len(at), *found[0][k].shape[1:]), np.float64)
            np.add.at(total[k], which, np.concatenate([x[k] for x in found]))
    return pa.table({"part": pa.array([part], pa.int32()), "data": pa.array([pack_arrays(**total)], pa.binary())})


def fit_shards(data: DataFrame, share: float, seed: int = 11) -> bytes:
    """:func:`fit` over any number of stored shards, see :func:`shards_of`.

    In each round every shard takes one pass from the common model, and the changes are averaged: those of a bucket over the shards that
    have moved it, all others over all shards. Languages move by one step of k-means a round, over all documents; they start from groups of the
    first shard. Cuts come from counts of all held-back documents. The driver sees the model and these counts alone, which are of bounded size.
    """
    context = data.sparkSession.sparkContext
    rows = "part int, data binary"

    def first_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, samples, _ in shards_of(batches):
            found = language_groups(np.array([profile(s) for s in samples], np.float32), np.random.default_rng(seed))
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([pack_arrays(centres=found)], pa.binary())], ["part", "data"])

    first = data.where(F.col("shard") == data.agg(F.min("shard")).scalar())
    centres = unpack_arrays(bytes(arrow_map(first, first_groups, rows).first().data))["centres"]
    m, _ = arrays_at_start(share, seed)
    for number in range(ROUNDS):
        sent = context.broadcast(pack_arrays(**m, centres=centres))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            old = unpack_arrays(sent.value)
            centres, sums = old.pop("centres"), {}
            for shard, samples, labels in shards_of(batches):
                new = {k: x.copy() for k, x in old.items()}
                learn = np.flatnonzero(~held_back(labels))
                descend(new, [word_ids(s) for s in samples], labels, learn, np.random.default_rng([seed, number, shard]), 1)
                _changes(old, new, sums)
                found = np.array([profile(s) for s in samples], np.float32)
                own = languages(found, centres)
                groups = np.stack([found[own == i].sum(0, dtype=np.float64) for i in range(len(centres))]) if len(centres) else np.zeros((0, PROFILE))
                sums["groups"] = sums.get("groups", 0.0) + groups
                sums["shards"] = sums.get("shards", 0) + np.array(1)
            if sums:
                found = list(_in_parts(sums))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["part", "data"])

        for row in arrow_map(data, run, rows).groupBy("part").applyInArrow(_add_up, rows).toLocalIterator():
            total = unpack_arrays(bytes(row.data))
            if row.part == PARTS:
                size = np.linalg.norm(total["groups"], axis=1, keepdims=True)
                centres = np.where(size > 0, total["groups"] / np.maximum(size, 1e-12), centres).astype(np.float32)
                for k in m:
                    if k in total:
                        m[k] = (m[k] + total[k] / total["shards"]).astype(np.float32)
            else:
                for k in ("table", "seen_table"):
                    m[k][total["at"]] += (total[k] / total["movers"][:, None]).astype(np.float32)
        sent.unpersist()
    m = settled(m)
    sent = context.broadcast(pack_arrays(**m, centres=centres))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = unpack_arrays(sent.value)
        for _, samples, labels in shards_of(batches):
            at = np.flatnonzero(held_back(labels))
            found = np.array([profile(samples[i]) for i in at], np.float32).reshape(-1, PROFILE)
            c = score_counts(sample_scores(m, [word_ids(samples[i]) for i in at]), labels[at], languages(found, m["centres"]), CUT_STEPS)
            yield pa.RecordBatch.from_arrays([pa.array(c[k]) for k in COUNTS], list(COUNTS))

    counted = arrow_map(data, count, "language long, step double, n long, hits long, low double, high double").groupBy("language", "step").agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.min("low").alias("low"), F.max("high").alias("high")
    ).toArrow()
    cuts = language_cuts({k: counted.column(k).to_numpy() for k in COUNTS}, len(centres))
    return pack_arrays(**m, cuts=cuts, centres=centres)


def raw_scores(table: np.ndarray, filters: dict[int, np.ndarray], out: np.ndarray, bias: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    learnt = table.any(1)
    # A word of which training has not moved every bucket is unknown; one that only shares a bucket with a toxic word says nothing.
    known = learnt[ids].all(1)
    vectors = np.zeros((len(ids), DIMENSIONS), np.float32)
    vectors[known] = table[ids[known]].sum(1)
    features, _ = pooled(vectors, counts, filters)
    return logistic(features.astype(np.float64) @ out + float(bias))


def scorer(model: bytes) -> Callable[[list[str]], np.ndarray]:
    """Texts to scores in which each language's cut lies at ``CUT``; a text without words gets the bias alone."""
    m = unpack_arrays(model)
    filters = {w: m[f"filters_{w}"] for w in WIDTHS}

    def score(texts: list[str]) -> np.ndarray:
        hashes, counts = tokens(texts)
        raw = raw_scores(m["table"], filters, m["out"], m["bias"], buckets(hashes), counts)
        return logistic(logit(raw) - logit(m["cuts"])[languages(profiles(texts), m["centres"])] + logit(CUT))

    return score


def train_toxicity(docs: DataFrame, labels: DataFrame, shard_docs: int = SHARD_DOCS, label: str = "toxic", key: str = "doc_id", text: str = "text") -> bytes:
    """Learn from the whole texts of all labelled documents, about ``shard_docs`` of them in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, "text"):
            hashes, counts = tokens(texts)
            words = [x.tobytes() for x in np.split(buckets(hashes).astype("<u2"), np.cumsum(counts)[:-1])]
            # In as few bytes as the largest count takes.
            found = [x.astype(f"<u{np.min_scalar_type(x.max()).itemsize}").tobytes() for x in trigrams(texts)]
            columns = [rows.column("shard"), rows.column("label"), pa.array(words, pa.binary()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "label", "words", "trigrams"])

    def fit_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, samples, y in shards_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([fit(samples, y)], pa.binary())], ["model"])

    known = labelled_keys(docs, labels, label, key).select(F.col(key).alias("key"), F.col("_label").alias("label")).where("label in (0, 1)")
    known = stored(known, "labelled")
    size = known.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits")).first()
    if not size.n or size.hits in (0, size.n):
        # One class or none: there is nothing to learn from texts.
        return fit([], np.full(min(size.n, 1), size.hits and 1, np.int64))
    shards = -(-size.n // shard_docs)
    node = F.unhex(F.md5(F.col("key").cast("string").cast("binary"))).alias("node")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("key is not null")
    # Texts without a label do not move, and those that do move once: they meet their label where their shard is put together.
    found = with_families(rows.select("*", node), known.select(node)).select("key", "text", F.lit(None).cast("int").alias("label"))
    marks = known.select("key", F.lit(None).cast("string").alias("text"), "label")
    dealt = found.unionByName(marks).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    # Repeated rows of a document would count it twice.
    once = dealt.groupBy("shard", "key").agg(F.first("text", True).alias("text"), F.max("label").alias("label")).where("label is not null")
    once = once.sortWithinPartitions("shard", "key")
    made = arrow_map(once, run, "shard int, label int, words binary, trigrams binary")
    if shards == 1:
        return bytes(arrow_map(made, fit_one, "model binary").first().model)
    return fit_shards(stored(made, "toxicity-shards"), size.hits / size.n)


def score_toxicity(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted): how toxic every whole text is; 1 where the score is at least ``CUT``.

    Null texts count as empty; repeated rows, null keys and empty tables pass through; other columns, the given language among
    them, are never read.
    """
    return score_texts(docs, model, scorer, key, text).withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def drop_toxic(docs: DataFrame, model: bytes, threshold: float = CUT, text: str = "text") -> DataFrame:
    """The documents scored below ``threshold``, with all their columns, of whatever name; null and empty texts are scored as empty and mostly stay."""
    return keep_rows(docs, model, scorer, lambda s: s < threshold, text)
