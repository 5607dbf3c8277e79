"""Helpers of this subpackage: bounded batches of texts, vectorised word hashes, table access, files in shared folders."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.operators.layout import shared_folder

# Characters of text that are worked on at once inside a task, whatever the size of the Arrow batch.
SLICE_CHARS = 1_000_000

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
# The lowest 0 to 8 bytes of a lane.
_LANE_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: str, n: int) -> Column:
    """crc32 of a key as text, modulo ``n``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "llm") -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be no column of ``df``, in any case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """(rows, their texts with null as empty), cut so that one slice holds about ``chars`` bytes of text or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(column), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + chars, "right")))
            yield batch.slice(at, to - at), texts.slice(at, to - at).to_pylist()
            at = to


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def byte_table(separators: bytes, lower: bool = False) -> bytes:
    """Translation of bytes: all ``separators`` become a space; with ``lower`` A-Z become a-z."""
    t = bytearray(range(256))
    if lower:
        for b in range(65, 91):
            t[b] = b + 32
    for b in separators:
        t[b] = 32
    return bytes(t)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all space-separated words of the texts in order, and the number of words of each text.

    Bytes other than the space are word characters. A word's hash sums its lanes of eight bytes, each spread by a mix that depends on the
    lane's place, so that no sum of products over the bytes can cancel out; the word's length goes in last. It is the same on
    every machine, and no Python loop runs over words.
    """
    raw = np.frombuffer(b" ".join(texts) + b" " + bytes(8), np.uint8)
    n = len(raw) - 8
    inside = raw[:n] != 32
    change = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    starts, ends = change[::2], change[1::2]
    size = ends - starts
    # Eight bytes from every place of the text on.
    window = np.ndarray((n,), "<u8", raw.data, strides=(1,))

    def lane(at: np.ndarray, left: np.ndarray, place: np.ndarray) -> np.ndarray:
        return mix((window[at] & _LANE_MASK[np.minimum(left, 8)]) ^ mix(place * _P + _M1))

    h = lane(starts, size, np.zeros(1, np.uint64))
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3
        place = ranges(more) + 1
        at = np.repeat(starts[long], more) + 8 * place
        h[long] += np.add.reduceat(lane(at, np.repeat(ends[long], more) - at, place.astype(np.uint64)), np.cumsum(more) - more)
    limits = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return mix(h + size.astype(np.uint64) * _P), np.diff(np.searchsorted(starts, limits), prepend=0)


def segment_sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``counts`` values; an empty run gives zero."""
    total = np.zeros((len(counts), *values.shape[1:]), values.dtype)
    full = counts > 0
    if full.any():
        total[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0)
    return total


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def write_file(path: str, chunks: Iterator[bytes] | list[bytes]) -> int:
    """Write a whole file in a shared folder, for any file system Arrow knows: a private name first, then the final one.

    A task that is tried again or twice replaces the file by an equal one; readers never see half of it.
    """
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    private, size = f"{at}.{uuid.uuid4().hex}", 0
    with system.open_output_stream(private) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    system.move(private, at)
    return size


def open_file(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return system.open_input_file(at)


def kept_in_worker(key: tuple, make: Callable[[], object]) -> object:
    """What ``make()`` gave the first time in this Python process; tasks that follow in a reused worker find it again.

    Functions of this package travel to workers by value, so a cache in a module would begin anew with every task.
    """
    made = sys.modules.setdefault("_tagweave_worker", types.ModuleType("_tagweave_worker")).__dict__.setdefault("made", {})
    if key not in made:
        made[key] = make()
    return made[key]


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)
