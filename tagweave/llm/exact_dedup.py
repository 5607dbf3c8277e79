"""Exact duplicates: composable polynomial fingerprints find groups, a streaming comparison chunk by chunk decides.

A text is a number in base ``BASE`` modulo 2**61 - 1, its digits the 32-bit words of its bytes. The hash of two stretches put together is
``h1 * BASE**words(2) + h2``, so all chunks of a batch are hashed at once as lanes of one array, chunks make up pieces, and the pieces of a
huge text, which never has to fit into a batch, make up the text. Fingerprints only propose: texts of one fingerprint and length are compared byte
by byte, in their own task first, then one carrier per task and text against the others, chunk number by chunk number.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import arrow_map, free_names, mix, ranges, stored

MODULUS = np.uint64((1 << 61) - 1)
# A fixed number below the modulus, taken from the mix of 61.
BASE = int(mix(np.array([61], np.uint64))[0]) % int(MODULUS)
# Chunks that are hashed as lanes and compared; a multiple of four.
CHUNK_BYTES = 1 << 16
# Texts above this come to the workers in several pieces of it; a multiple of the chunk.
PIECE_BYTES = 1 << 22
# Bits of the filter that says which fingerprints may occur twice: 2 MiB, whatever the corpus.
FILTER_BITS = 1 << 24
# Bytes of texts that a task remembers to compare with.
HELD_BYTES = 32 << 20
# Groups above one in this many rows are hot; fewer than this many exist.
HOT = 4096

_30, _31, _32 = np.uint64(30), np.uint64(31), np.uint64(32)
_LOW30, _LOW31, _LOW32 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1), np.uint64((1 << 32) - 1)


def _fold(x: np.ndarray) -> np.ndarray:
    """Any 64 bits modulo 2**61 - 1."""
    x = (x & MODULUS) + (x >> np.uint64(61))
    return np.where(x >= MODULUS, x - MODULUS, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of numbers below 2**61 - 1 modulo it, from 31-bit halves."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _fold(((a1 * b1) << np.uint64(1)) + (middle >> _30) + ((middle & _LOW30) << _31) + a0 * b0)


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    out, square = np.ones(len(exponents), np.uint64), np.array([base], np.uint64)
    left = exponents.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)) == 1
        out[odd] = times(out[odd], square)
        left, square = left >> np.uint64(1), times(square, square)
    return out


def chunk_hashes(chunks: list[bytes], base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of 32-bit words) of every chunk; neighbours are put together in rounds, all lanes of all chunks at once."""
    words = np.fromiter((-(-len(c) // 4) for c in chunks), np.int64, len(chunks))
    # Zero words in front change no value; with them every chunk is whole rows of 16 words.
    rows = -(-words // 16)
    parts = []
    for c, w, r in zip(chunks, words.tolist(), rows.tolist(), strict=True):
        parts += [bytes(4 * (16 * r - w)), c, bytes(4 * w - len(c))]
    v, step = np.frombuffer(b"".join(parts), "<u4").astype(np.uint64).reshape(-1, 16), np.array([base], np.uint64)
    while v.shape[1] > 1:
        v, step = _fold(times(v[:, 0::2], step) + v[:, 1::2]), times(step, step)
    v, counts = v.ravel(), rows
    while len(counts) and counts.max() > 1:
        pairs = (counts + 1) // 2
        even = np.zeros(2 * int(pairs.sum()), np.uint64)
        even[np.repeat(2 * (np.cumsum(pairs) - pairs) + counts % 2, counts) + ranges(counts)] = v
        v, step, counts = _fold(times(even[0::2], step) + even[1::2]), times(step, step), pairs
    out = np.zeros(len(chunks), np.uint64)
    out[counts > 0] = v
    return out, words


def combined(hashes: np.ndarray, words: np.ndarray, per_text: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash of each text from its consecutive chunks: every chunk is shifted by the words behind it."""
    out = np.zeros(len(per_text), np.uint64)
    full = per_text > 0
    if not full.any():
        return out
    first = (np.cumsum(per_text) - per_text)[full]
    ends = np.cumsum(words)
    after = np.repeat(ends[first + per_text[full] - 1], per_text[full]) - ends
    shifted = times(hashes, powers(base, after))
    high, low = np.add.reduceat(shifted >> _32, first), np.add.reduceat(shifted & _LOW32, first)
    out[full] = _fold(times(_fold(high), np.array([1 << 32], np.uint64)) + _fold(low))
    return out


def text_hashes(texts: list[bytes], base: int = BASE, chunk_bytes: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, number of words) of whole texts."""
    chunks = [t[i : i + chunk_bytes] for t in texts for i in range(0, len(t), chunk_bytes)]
    per_text = np.fromiter((-(-len(t) // chunk_bytes) for t in texts), np.int64, len(texts))
    hashes, words = chunk_hashes(chunks, base)
    return combined(hashes, words, per_text, base), np.fromiter((-(-len(t) // 4) for t in texts), np.int64, len(texts))


class Huge:
    """A text that comes in pieces: its fingerprint and digest so far."""

    def __init__(self, key: pa.Array, row: int):
        self.key, self.row, self.hash, self.size, self.sha, self.chunks = key, row, np.zeros(1, np.uint64), 0, hashlib.sha256(), 0

    def add(self, piece: bytes, base: int, chunk_bytes: int) -> None:
        h, words = text_hashes([piece], base, chunk_bytes)
        self.hash = _fold(times(self.hash, powers(base, words)) + h)
        self.size += len(piece)
        self.sha.update(piece)


def _probes(fingerprints: np.ndarray, sizes: np.ndarray, bits: int) -> list[np.ndarray]:
    spread = mix(mix(fingerprints) + sizes.astype(np.uint64))
    return [(spread >> np.uint64(shift)) % np.uint64(bits) for shift in (0, 32)]


def _pieces(docs: DataFrame, key: str, text: str, piece_bytes: int) -> DataFrame:
    """(_key, _size, _at, _piece): each text's bytes, those of long texts in consecutive pieces."""
    raw = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("_raw"))
    last = F.expr(f"cast((greatest(octet_length(_raw), 1) - 1) div {piece_bytes} as int)")
    cut = raw.select("_key", F.octet_length("_raw").cast("long").alias("_size"), "_raw", F.explode(F.sequence(F.lit(0), last)).alias("_at"))
    piece = F.when(F.col("_size") <= piece_bytes, F.col("_raw")).otherwise(F.expr(f"substring(_raw, _at * {piece_bytes} + 1, {piece_bytes})"))
    return cut.select("_key", "_size", "_at", piece.alias("_piece"))


def _slices(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[bytes]]]:
    """(keys, text sizes, piece numbers, lower-cased pieces), about ``chars`` bytes at once."""
    for batch in batches:
        pieces = batch.column("_piece")
        sizes, at_piece = batch.column("_size").to_numpy(), batch.column("_at").to_numpy()
        ends = np.cumsum(np.minimum(sizes, chars) + 1)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars, "right")))
            # Lower-casing of bytes touches A to Z alone.
            yield batch.column("_key").slice(at, to - at), sizes[at:to], at_piece[at:to], [p.lower() for p in pieces.slice(at, to - at).to_pylist()]
            at = to


def repeated_filter(pieces: DataFrame, base: int, piece_bytes: int, chunk_bytes: int, bits: int) -> np.ndarray:
    """Bits of a Bloom filter over the fingerprints that occur more than once. Only its words, of a fixed number, come to the driver."""

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: Huge | None = None
        for keys, sizes, at, texts in _slices(batches, piece_bytes):
            whole = sizes <= piece_bytes
            own = [t for t, w in zip(texts, whole, strict=True) if w]
            found, size = text_hashes(own, base, chunk_bytes)[0].tolist(), sizes[whole].tolist()
            for i in np.flatnonzero(~whole).tolist():
                if at[i] == 0:
                    open_ = Huge(keys, 0)
                open_.add(texts[i], base, chunk_bytes)
                if open_.size == sizes[i]:
                    found.append(int(open_.hash[0]))
                    size.append(int(sizes[i]))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(size, pa.int64())], ["fingerprint", "n_bytes"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits, bool)
        for batch in batches:
            for p in _probes(batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy(), bits):
                flags[p.astype(np.int64)] = True
        packed = np.packbits(flags, bitorder="little").view("<i8")
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed[at], pa.int64())], ["word", "bits"])

    counted = arrow_map(pieces, fingerprints, "fingerprint long, n_bytes long").groupBy("fingerprint", "n_bytes").agg(F.count(F.lit(1)).alias("_n"))
    twice = counted.where("_n > 1").select("fingerprint", "n_bytes")
    found = arrow_map(twice, words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def carriers(pieces: DataFrame, flags: np.ndarray, base: int, piece_bytes: int, chunk_bytes: int, held_bytes: int) -> DataFrame:
    """Rows of two kinds. ``_at`` null: one per document with its fingerprint, digest and carrier, null where no text can equal it. Else a
    chunk of a carrier's text: each text that a task meets and does not remember becomes a carrier, later equal ones only name it."""
    bits = len(flags) * 8
    sent = pieces.sparkSession.sparkContext.broadcast(flags.tobytes())
    kind = pieces.schema["_key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(sent.value, np.uint8)
        held: OrderedDict[tuple[int, int], list[tuple[int, bytes]]] = OrderedDict()
        n_held, row = 0, TaskContext.get().partitionId() << 33
        open_: Huge | None = None
        for keys, sizes, at, texts in _slices(batches, piece_bytes):
            whole = sizes <= piece_bytes
            hashes = np.zeros(len(texts), np.uint64)
            hashes[whole] = text_hashes([t for t, w in zip(texts, whole, strict=True) if w], base, chunk_bytes)[0]
            maybe = np.ones(len(texts), bool)
            for p in _probes(hashes, sizes, bits):
                maybe &= (flags[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            members: dict[str, list] = {c: [] for c in ("at", "row", "fingerprint", "n_bytes", "sha", "carrier")}
            chunks: dict[str, list] = {c: [] for c in ("carrier", "fingerprint", "n_bytes", "at", "chunk")}

            def member(i: int, row: int, h: int, n: int, sha: str, carrier: int | None, out: dict = members) -> None:
                for c, v in zip(out, (i, row, h, n, sha, carrier), strict=True):
                    out[c].append(v)

            def send(carrier: int, h: int | None, n: int, first: int, text: bytes, out: dict = chunks) -> None:
                for k, j in enumerate(range(0, len(text), chunk_bytes)):
                    for c, v in zip(out, (carrier, h, n, first + k, text[j : j + chunk_bytes]), strict=True):
                        out[c].append(v)

            for i, text in enumerate(texts):
                if not whole[i]:
                    if at[i] == 0:
                        row += 1
                        open_ = Huge(keys, row)
                    # Its fingerprint is known at the end only, so its chunks go out without one.
                    send(open_.row, None, int(sizes[i]), open_.chunks, text)
                    open_.chunks += -(-len(text) // chunk_bytes)
                    open_.add(text, base, chunk_bytes)
                    if open_.size == sizes[i]:
                        member(i, open_.row, int(open_.hash[0]), open_.size, open_.sha.hexdigest(), open_.row)
                    continue
                row += 1
                h, n, sha = int(hashes[i]), len(text), hashlib.sha256(text).hexdigest()
                if not maybe[i]:
                    member(i, row, h, n, sha, None)
                    continue
                known = held.setdefault((h, n), [])
                held.move_to_end((h, n))
                carrier = next((c for c, t in known if t == text), None)
                if carrier is None:
                    carrier = row
                    known.append((row, text))
                    n_held += n + 200
                    send(row, h, n, 0, text)
                    while n_held > held_bytes and len(held) > 1:
                        n_held -= sum(len(t) + 200 for _, t in held.popitem(last=False)[1])
                member(i, row, h, n, sha, carrier)
            n_members, n_chunks = len(members["at"]), len(chunks["at"])
            none = lambda n, t: pa.nulls(n, t)
            own = keys.take(pa.array(members["at"], pa.int64()))
            long, text_, binary = pa.int64(), pa.string(), pa.binary()
            for columns in (
                [own, *(pa.array(members[c], long) for c in ("row", "fingerprint", "n_bytes")), pa.array(members["sha"], text_), pa.array(members["carrier"], long),
                 none(n_members, long), none(n_members, binary)],
                [none(n_chunks, own.type), none(n_chunks, long), pa.array(chunks["fingerprint"], long), pa.array(chunks["n_bytes"], long), none(n_chunks, text_),
                 pa.array(chunks["carrier"], long), pa.array(chunks["at"], long), pa.array(chunks["chunk"], binary)],
            ):
                yield pa.RecordBatch.from_arrays(columns, ["_key", "_row", "fingerprint", "n_bytes", "text_sha256", "_carrier", "_at", "_chunk"])

    schema = f"_key {kind.simpleString()}, _row long, fingerprint long, n_bytes long, text_sha256 string, _carrier long, _at long, _chunk binary"
    return arrow_map(pieces, run, schema)


def variants(chunks: DataFrame) -> DataFrame:
    """(_carrier, _variant) of the carriers whose text differs from the least carrier's of their fingerprint and length.

    Chunks are dealt by fingerprint, length and place and stream past in order of the carrier; only the different contents met at
    one place are held. ``_variant`` lists the places that differ and which content stands there, so equal variants are equal texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, contents = None, []
        for batch in batches:
            found: tuple[list, list, list] = ([], [], [])
            where = zip(*(batch.column(c).to_pylist() for c in ("fingerprint", "n_bytes", "_at")), strict=True)
            for here, carrier, chunk in zip(where, batch.column("_carrier").to_pylist(), batch.column("_chunk"), strict=True):
                chunk = chunk.as_buffer()
                if here != place:
                    place, contents = here, [chunk.to_pybytes()]
                    continue
                which = next((i for i, c in enumerate(contents) if chunk.equals(pa.py_buffer(c))), None)
                if which is None:
                    which = len(contents)
                    contents.append(chunk.to_pybytes())
                if which:
                    for c, v in zip(found, (carrier, here[2], which), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["_carrier", "_at", "_which"])

    place = ["fingerprint", "n_bytes", "_at"]
    dealt = chunks.select(*place, "_carrier", "_chunk").repartition(*place).sortWithinPartitions(*place, "_carrier")
    differing = arrow_map(dealt, run, "_carrier long, _at long, _which long")
    return differing.groupBy("_carrier").agg(F.to_json(F.array_sort(F.collect_list(F.struct("_at", "_which")))).alias("_variant"))


def exact_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", base: int = BASE, piece_bytes: int = PIECE_BYTES, chunk_bytes: int = CHUNK_BYTES,
    filter_bits: int = FILTER_BITS, held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: key, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``n_bytes`` and ``fingerprint``.

    Texts are equal if they agree byte by byte after lower-casing A to Z; null counts as empty, and all empty texts are equal. ``keep_id`` is the
    largest key of the equal texts, null only if they have no other; of rows that repeat key and text one has ``kept``. The digest is
    that of the lower-cased text. Other columns are ignored; an empty table gives an empty one. ``base`` and the sizes decide
    the way only: with any of them the groups are the same.
    """
    if piece_bytes % chunk_bytes or chunk_bytes % 4 or filter_bits % 64:
        raise ValueError("a piece is whole chunks, a chunk whole words of four bytes, the filter whole words of 64 bits")
    pieces = _pieces(docs, key, text, piece_bytes)
    flags = repeated_filter(pieces, base, piece_bytes, chunk_bytes, filter_bits)
    rows = stored(carriers(pieces, flags, base, piece_bytes, chunk_bytes, held_bytes), "carriers")
    members = rows.where(F.col("_at").isNull()).drop("_at", "_chunk")
    chunks = rows.where(F.col("_at").isNotNull()).select("_carrier", "fingerprint", "n_bytes", "_at", "_chunk")
    late = chunks.where(F.col("fingerprint").isNull()).drop("fingerprint", "n_bytes")
    late = late.join(members.where(F.col("n_bytes") > piece_bytes).select("_carrier", "fingerprint", "n_bytes"), "_carrier")
    chunks = chunks.where(F.col("fingerprint").isNotNull()).unionByName(late)
    differing = stored(variants(chunks), "variants")
    alone = members.where(F.col("_carrier").isNull()).select(
        "_key", F.col("_key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "n_bytes", "fingerprint"
    )
    paired = members.where(F.col("_carrier").isNotNull()).join(differing, "_carrier", "left")
    paired = paired.withColumn("_variant", F.coalesce("_variant", F.lit(""))).drop("_carrier")
    group = ["fingerprint", "n_bytes", "_variant"]
    # The largest struct: a null key is less than any other.
    best = F.max(F.struct("_key", "_row"))
    sizes = stored(paired.groupBy(*group).agg(F.count(F.lit(1)).alias("group_size"), best.alias("_best")), "groups")
    hot = F.col("group_size") > members.count() / HOT
    # At most HOT groups are hot, so they may be sent everywhere; rows of the others meet their group by a join.
    with_hot = paired.join(F.broadcast(sizes.where(hot)), group, "left")
    settled = with_hot.where(F.col("group_size").isNotNull())
    others = with_hot.where(F.col("group_size").isNull()).drop("group_size", "_best").join(sizes.where(~hot), group)
    named = settled.unionByName(others).select(
        "_key", F.col("_best._key").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best._row")).alias("kept"), "text_sha256", "n_bytes", "fingerprint"
    )
    return alone.unionByName(named).withColumnRenamed("_key", key)


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns; of rows that repeat key and text one stays, whichever comes first.

    Null texts count as empty: of all null and empty texts the one of the largest key stays.
    """
    groups = stored(exact_groups(docs, key, text, **sizes), "exact-groups")
    own, sha, twice = free_names(docs, "_own", "_sha", "_twice")
    upper = "".join(map(chr, range(65, 91)))
    same = groups.groupBy(F.col(key).alias(own), F.col("text_sha256").alias(sha)).agg(F.max("kept").alias("kept"), (F.count(F.lit(1)) > 1).alias(twice))
    first = stored(same.where("kept").drop("kept"), "exact-kept")
    (text_sha,) = free_names(docs, "_text_sha")
    marked = docs.withColumn(text_sha, F.sha2(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), upper, upper.lower()).cast("binary"), 256))
    match = F.col(key).eqNullSafe(F.col(own)) & (F.col(text_sha) == F.col(sha))
    once = marked.join(first.where(~F.col(twice)), match, "left_semi")
    repeated = marked.join(first.where(F.col(twice)), match, "left_semi").dropDuplicates([key, text_sha])
    return once.unionByName(repeated).drop(text_sha)
