"""Token-id files: ids of many documents, bit-packed at the vocabulary's width, in blocks that can be read on their own."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.llm.common import arrow_map, new_folder, open_file, stored, text_slices, write_file

MAGIC = b"TWIDS\x01\x00\x00"
# magic, bits per id, ids per block, documents, ids, place of the block offsets, place of the document table
HEADER = "<8sQQQQQQ"
BLOCK_IDS = 4096
DOCS_PER_SHARD = 4096
DOC_ROW = np.dtype([("id", "<i8"), ("known", "<u8"), ("end", "<u8")])


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as one little-endian bit stream, filled up with zeros to a multiple of 64 ids; 64 ids fill ``bits`` 64-bit words."""
    if not len(ids):
        return b""
    if int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    lanes = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(lanes), bits), np.uint64)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        words[:, word] |= lanes[:, i] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, i] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of :func:`pack`'s output."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    lanes, mask = np.empty((len(words), 64), np.uint64), np.uint64((1 << bits) - 1)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        lanes[:, i] = x & mask
    return lanes.reshape(-1)[:n].astype(np.uint32)


class ShardWriter:
    """Chunks of one file. The body streams out block by block; offsets and the document table follow, and the head is written last
    as a fixed-size tail, so nothing but the document table is held in memory."""

    def __init__(self, bits: int, block_ids: int = BLOCK_IDS):
        self.bits, self.block_ids = bits, block_ids
        self.waiting, self.n_waiting = [], 0
        self.keys, self.known, self.sizes, self.offsets, self.at, self.n_ids = [], [], [], [], 0, 0

    def _blocks(self, ids: np.ndarray) -> Iterator[bytes]:
        for i in range(0, len(ids), self.block_ids):
            data = pack(ids[i : i + self.block_ids], self.bits)
            self.offsets.append(self.at)
            self.at += len(data)
            yield data

    def add(self, keys: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> Iterator[bytes]:
        self.keys += [0 if k is None else k for k in keys]
        self.known += [k is not None for k in keys]
        self.sizes += sizes.tolist()
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= 64 * self.block_ids:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // self.block_ids * self.block_ids
            self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole
            yield from self._blocks(ids[:whole])

    def close(self) -> Iterator[bytes]:
        if self.waiting:
            yield from self._blocks(np.concatenate(self.waiting))
        docs = np.zeros(len(self.keys), DOC_ROW)
        docs["id"], docs["known"], docs["end"] = self.keys, self.known, np.cumsum(self.sizes)
        offsets = np.array([*self.offsets, self.at], "<u8").tobytes()
        yield offsets
        yield docs.tobytes()
        yield struct.pack(HEADER, MAGIC, self.bits, self.block_ids, len(docs), self.n_ids, self.at, self.at + len(offsets))


class ShardReader:
    """Random access to one file: any range of ids reads only the blocks that it touches."""

    def __init__(self, path: str):
        self.file = open_file(path)
        tail = self._read(self.file.size() - struct.calcsize(HEADER), struct.calcsize(HEADER))
        magic, self.bits, self.block_ids, self.n_docs, self.n_ids, offsets_at, docs_at = struct.unpack(HEADER, tail)
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.offsets = np.frombuffer(self._read(offsets_at, docs_at - offsets_at), "<u8").astype(np.int64)
        self.docs = np.frombuffer(self._read(docs_at, self.n_docs * DOC_ROW.itemsize), DOC_ROW)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        data = self._read(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        # Blocks are whole groups of 64 ids, so consecutive ones unpack as one stream.
        ids = unpack(data, self.bits, min((last + 1) * self.block_ids, self.n_ids) - first * self.block_ids)
        return ids[start - first * self.block_ids : end - first * self.block_ids]

    def documents(self, at_once: int = 2_000_000) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, first position, ids) of each document in order, read in large strides."""
        ends = self.docs["end"].astype(np.int64)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        i = 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + at_once, "right")))
            ids = self.ids(int(starts[i]), int(ends[j - 1]))
            for k in range(i, j):
                row = self.docs[k]
                yield (int(row["id"]) if row["known"] else None), int(starts[k]), ids[starts[k] - starts[i] : ends[k] - starts[i]]
            i = j


def write_token_files(
    docs: DataFrame, folder: str, encoder: Callable[[], object], vocabulary: int, end_id: int = 0, key: str = "doc_id", text: str = "text",
    docs_per_shard: int = DOCS_PER_SHARD,
) -> DataFrame:
    """Write all documents in ascending key order as files of packed ids; return the manifest (shard, path, n_docs, n_ids, bytes).

    ``encoder()`` is called inside tasks and gives an object with ``encode(texts) -> (ids, ids per text)``. ``end_id`` is
    appended to each document. The table is range-partitioned by key, a partition is one file; a null text counts as empty,
    null keys come first, repeated rows are written once each (in the order of their text's hash), other columns are ignored.
    An empty table gives no files. A file appears under its name only when it is whole, so tasks may run again.
    """
    bits = bits_for(vocabulary)
    n_shards = max(1, -(-docs.count() // docs_per_shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        path, tool, out = f"{folder}/shard-{shard:08d}.twids", encoder(), ShardWriter(bits)

        def chunks() -> Iterator[bytes]:
            for rows, texts in text_slices(batches, text):
                ids, n = tool.encode(texts)
                # The end id goes behind each document.
                with_end = np.insert(ids, np.cumsum(n), end_id).astype(np.uint32)
                yield from out.add(rows.column(key).to_pylist(), with_end, n + 1)
            if out.keys:
                yield from out.close()

        stream = chunks()
        first = next(stream, None)
        if first is None:
            return
        size = write_file(path, (x for part in ([first], stream) for x in part))
        row = {"shard": [shard], "path": [path], "n_docs": [len(out.keys)], "n_ids": [out.n_ids], "bytes": [size]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([(c, pa.string() if c == "path" else pa.int64()) for c in row]))

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)).withColumn("_h", F.xxhash64(text))
    ranged = rows.repartitionByRange(n_shards, key, "_h").sortWithinPartitions(key, "_h").drop("_h")
    return stored(arrow_map(ranged, run, "shard long, path string, n_docs long, n_ids long, bytes long"), "manifest")


def read_token_files(manifest: DataFrame, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of every document from its file; ``start`` counts the ids of all documents before it.

    ``ids_crc32`` is the unsigned CRC-32 of the ids as little-endian 32-bit integers. ``ids=False`` leaves the lists in the tasks.
    """
    # One narrow row per file; the sum over all files before a file is its first position.
    before = F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    # One file a task: the manifest is a few bytes, and Spark would else put all of it into one.
    files = manifest.select("shard", "path", F.coalesce(before, F.lit(0)).alias("first")).repartition(max(1, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                rows: list[tuple] = []
                held = 0
                for k, start, own in ShardReader(path).documents():
                    rows.append((k, first + start, len(own), zlib.crc32(own.astype("<u4").tobytes()), own if ids else None))
                    held += len(own)
                    if held > 4_000_000:
                        yield as_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        names, kinds = [key, "start", "n_tokens", "ids_crc32"], [pa.int64()] * 4
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        if ids:
            names.append("ids")
            columns.append(pa.array([r[4].astype(np.int64) for r in rows], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(files, run, f"{key} long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def token_file_folder(docs: DataFrame) -> str:
    return new_folder(docs.sparkSession, "token-files")
