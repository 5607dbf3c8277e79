"""What the text classifiers share: labelled samples, one training task, models that travel to the scoring tasks."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import arrow_map, text_slices


def labelled_keys(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """(key, _label) of every labelled document, once with its largest label; null labels and keys take no part."""
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    return one.join(docs.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label) of at most ``per_class`` labelled documents of class 0 and 1, picked by a hash of the key.

    Only the narrow labels are ranked (Spark keeps the first rows of each task in front of the shuffle), then their texts are fetched.
    A document with several labels takes part once with its largest; null labels and keys take no part.
    """
    present = labelled_keys(docs, labels, label, key)
    parts = [present.where(F.col("_label") == c).orderBy(F.xxhash64(key), key).limit(n) for c, n in enumerate(per_class)]
    picked = parts[0].unionByName(parts[1])
    found = docs.select(key, F.coalesce(text, F.lit("")).alias(text)).join(picked, key)
    # Repeated rows of a document would count it twice.
    return found.groupBy(key).agg(F.first(text).alias(text), F.first("_label").alias("_label"))


def pack_arrays(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack_arrays(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in found.files}


def train_in_one_task(features: DataFrame, fit: Callable[[list[dict[str, np.ndarray]], np.ndarray], bytes]) -> bytes:
    """Fit on a bounded sample in one task; ``features`` has (key, label, data) with ``data`` from :func:`pack_arrays`.

    Rows are ordered by key, so the model does not depend on how they were dealt. Returns the model's bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(k, y, x) for b in batches for k, y, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
        rows.sort(key=lambda r: r[0])
        model = fit([unpack_arrays(x) for _, _, x in rows], np.array([y for _, y, _ in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    found = arrow_map(features.repartition(1), run, "model binary").collect()
    # Without any labelled row no task may have run.
    return bytes(found[0].model) if found else fit([], np.empty(0, np.int64))


def score_texts(docs: DataFrame, model: bytes, scorer: Callable[[bytes], Callable[[list[str]], np.ndarray]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row's whole text; the model, of fixed size, is sent to each executor once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(sent.value)
        for rows, texts in text_slices(batches, text):
            yield pa.RecordBatch.from_arrays([rows.column(key), pa.array(score(texts), pa.float64())], [key, "score"])

    kept = docs.select(key, text)
    return arrow_map(kept, run, f"{key} {kept.schema[key].dataType.simpleString()}, score double")


def keep_rows(docs: DataFrame, model: bytes, scorer: Callable[[bytes], Callable[[list[str]], np.ndarray]], keep: Callable[[np.ndarray], np.ndarray], text: str = "text") -> DataFrame:
    """The rows whose text's score passes ``keep``, with all their columns; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(sent.value)
        for rows, texts in text_slices(batches, text):
            kept = rows.filter(pa.array(keep(score(texts))))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(run, docs.schema)

