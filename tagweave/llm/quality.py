"""Quality classifier: hashed word and character n-gram vectors averaged per document, softmax over two classes, numpy SGD."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.classifiers import keep_rows, labelled_sample, pack_arrays, score_texts, train_in_one_task, unpack_arrays
from tagweave.llm.common import arrow_map, ranges, segment_sum, text_slices

BUCKET_BITS = 16
GRAMS = (3, 4, 5)
DIMENSIONS = 8
# Documents of class 0 and 1 that are learnt from; the sample is all that training reads.
SAMPLE_PER_CLASS = (1000, 1000)
EPOCHS, BATCH, RATE = 12, 16, 2.0

_GRAM_BASE = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BUCKET_BITS)


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of every feature in text order, features per document), one pair for each kind of feature.

    Text is lower-cased and white space becomes one space, also at both ends, so n-grams mark where words begin and end; no n-gram
    has a space inside. A pair of words counts as one of two features, equal or not. Words and n-grams are hashed into 2**BUCKET_BITS buckets by polynomials over code points.
    """
    clean = [" " + " ".join(t.lower().split()) + " " for t in texts]
    sizes = np.fromiter(map(len, clean), np.int64, len(clean))
    points = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum(sizes)
    space = points == 32
    codes = points.astype(np.uint64)

    def counted(starts: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(starts, ends), prepend=0)

    # A word's hash is a difference of prefix sums of its letters' spread codes, weighted by the place within the word.
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    finish = np.flatnonzero(~space[:-1] & space[1:]) + 1
    place = np.arange(len(points)) - np.repeat(np.concatenate(([0], begin)), np.diff(np.concatenate(([0], begin, [len(points)]))))
    spread = (codes + np.uint64(7)) * _SPREAD
    weighted = (spread ^ (spread >> np.uint64(29))) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(weighted)))
    words = (total[finish] - total[begin]) * _SPREAD
    n_words = counted(begin)
    yield (words >> _SHIFT).astype(np.int64), n_words
    # Whether a word repeats the one before it, as two buckets of their own behind the hashed ones.
    follows = ranges(n_words) > 0
    same = np.concatenate((np.zeros(min(1, len(words)), bool), words[1:] == words[:-1]))
    yield (1 << BUCKET_BITS) + same[follows].astype(np.int64), np.maximum(n_words - 1, 0)
    gram = codes
    spaces = np.concatenate(([0], np.cumsum(space)))
    for n in range(2, max(GRAMS) + 1):
        if len(points) < n:
            return
        gram = gram[:-1] * _GRAM_BASE + codes[n - 1 :]
        if n in GRAMS:
            # Characters 1..n-2 are inside; spaces at either end mark a word's edge.
            inner = spaces[n - 1 : len(points)] - spaces[1 : len(points) - n + 2]
            starts = np.flatnonzero(inner == 0)
            mixed = (gram[starts] + np.uint64(n)) * _SPREAD
            yield (mixed >> _SHIFT).astype(np.int64), counted(starts)


def feature_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, share of each among the document's features)."""
    found = [ids for ids, _ in features([text])]
    ids, n = np.unique(np.concatenate(found), return_counts=True)
    return ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


def fit(samples: list[dict[str, np.ndarray]], labels: np.ndarray, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, seed: int = 7) -> bytes:
    """Vectors, softmax weights and the score table; classes weigh alike. Without both classes the score is the share of class 1."""
    rng = np.random.default_rng(seed)
    table = np.zeros(((1 << BUCKET_BITS) + 2, dimensions), np.float32)
    weight = rng.normal(0, 1, (dimensions, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    if len(labels) and share.min() > 0:
        balance = (0.5 / share)[labels].astype(np.float32)
        steps, step = epochs * -(-len(labels) // BATCH), 0
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                rate = np.float32(RATE * (1 - step / steps))
                step += 1
                ids = np.concatenate([samples[i]["ids"] for i in rows])
                shares = np.concatenate([samples[i]["share"] for i in rows])
                sizes = np.array([len(samples[i]["ids"]) for i in rows])
                mean = segment_sum(table[ids] * shares[:, None], sizes)
                logits = mean @ weight + bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), labels[rows]] -= 1
                p *= balance[rows][:, None]
                back = p @ weight.T
                weight -= rate * mean.T @ p / len(rows)
                bias -= rate * 0.1 * p.mean(0)
                # The average's gradient reaches every feature by its share; features are many, so their rate is larger.
                np.add.at(table, ids, -rate * 20 * shares[:, None] * np.repeat(back, sizes, axis=0) / len(rows))
    elif len(labels):
        bias[:] = np.log(np.clip(share, 1e-3, 1)).astype(np.float32)
    # The softmax of an average is a logistic function of the average of one number per bucket.
    toward = table @ (weight[:, 1] - weight[:, 0])
    return pack_arrays(table=table, weight=weight, bias=bias, toward=toward.astype(np.float32))


def scorer(model: bytes) -> Callable[[list[str]], np.ndarray]:
    """Texts to the probability of class 1; an empty text has no features and gets the bias alone."""
    found = unpack_arrays(model)
    toward, offset = found["toward"].astype(np.float64), float(found["bias"][1]) - float(found["bias"][0])

    def score(texts: list[str]) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for ids, counts in features(texts):
            total += segment_sum(toward[ids], counts)
            n += counts
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + offset, -700, 700)))

    return score


def train_quality(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = SAMPLE_PER_CLASS, label: str = "quality", key: str = "doc_id", text: str = "text") -> bytes:
    """Learn from the texts of up to ``per_class`` labelled documents of class 0 and 1; features are made where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, text):
            data = []
            for t in texts:
                ids, share = feature_counts(t)
                data.append(pack_arrays(ids=ids, share=share))
            yield pa.RecordBatch.from_arrays([rows.column(key), rows.column("_label"), pa.array(data, pa.binary())], [key, "label", "data"])

    sample = labelled_sample(docs, labels, label, per_class, key, text)
    kind = sample.schema[key].dataType.simpleString()
    return train_in_one_task(arrow_map(sample, run, f"{key} {kind}, label int, data binary"), fit)


def score_quality(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted): probability of class 1 of every whole text and 1 where it is at least 0.5.

    Null texts count as empty; repeated rows, null keys and empty tables pass through; other columns are ignored.
    """
    return score_texts(docs, model, scorer, key, text).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_quality(docs: DataFrame, model: bytes, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The documents scored at least ``threshold``, with all their columns."""
    return keep_rows(docs, model, scorer, lambda s: s >= threshold, text)
