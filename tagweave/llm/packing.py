"""Best-fit packing of documents into sequences, with lower bounds that certify groups and repacking of those that have a gap."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import arrow_map, free_names, ranges, stored, text_slices

CAPACITY = 2048
# Expected pieces of one group; a group is packed inside one task.
GROUP_PIECES = 50_000
MAX_ROUNDS = 6


def token_pieces(
    docs: DataFrame, encoder: Callable[[], object], capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, piece, start, length, ids_crc32): every document's ids with ``end_id`` behind them, cut every ``capacity`` ids.

    A null text counts as empty (one id). Repeated rows and null keys give pieces of their own; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder()
        for rows, texts in text_slices(batches, text):
            ids, n = tool.encode(texts)
            ids, n = np.insert(ids, np.cumsum(n), end_id).astype("<u4"), n + 1
            pieces = -(-n // capacity)
            doc, piece = np.repeat(np.arange(len(n)), pieces), ranges(pieces)
            start = piece * capacity
            length = np.minimum(n[doc] - start, capacity)
            begin = (np.cumsum(n) - n)[doc] + start
            crc = [zlib.crc32(ids[a : a + m].tobytes()) for a, m in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = [rows.column(key).take(pa.array(doc)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, [key, "piece", "start", "length", "ids_crc32"])

    kept = docs.select(key, text)
    kind = kept.schema[key].dataType.simpleString()
    return arrow_map(kept, run, f"{key} {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins that any packing needs, by dual feasible functions.

    Two families over lengths x of a bin of 1: for a cut t, x above 1 - t counts 1 and x below t counts 0; for a whole k, x counts
    itself if (k+1)x is whole and floor((k+1)x)/k if not. Each maps any full bin to at most 1, so the sum of the mapped
    lengths, rounded up, is a bound; so is one family put on top of the other.
    """
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = 0
    for t in range(capacity // 2 + 1):
        cut = np.where(x > capacity - t, capacity, np.where(x < t, 0, x))
        best = max(best, -(-int((cut * count).sum()) // capacity))
        if t % 64 == 0:
            for k in range(1, 12):
                y = (k + 1) * cut
                # In units of 1 / (k * capacity).
                steps = np.where(y % capacity == 0, k * cut, y // capacity * capacity)
                best = max(best, -(-int((steps * count).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin of each piece, its offset in the bin, used length of each bin).

    Open bins are kept by the room that is left; a bit mask of the rooms in use gives the tightest fit at once.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if room > size:
            by_room[room - size].append(b)
            mask |= 1 << (room - size)
    return bins, offsets, np.array(used, np.int64)


def pack_group(rows: pa.Table, capacity: int, base: int, own: list[str]) -> pa.Table:
    lengths = rows.column("length").to_numpy()
    bins, offsets, used = best_fit(lengths, capacity)
    certified = len(used) == lower_bound(lengths, capacity)
    group, open_, first_ = own
    first = base + (rows.column(group)[0].as_py() << 28)
    for name, values in (("sequence_id", first + bins), ("offset", offsets), (open_, used[bins] <= (capacity // 2 if certified else capacity - 1)), (first_, offsets == 0)):
        rows = rows.append_column(name, pa.array(values))
    return rows


def _packer(capacity: int, base: int, own: list[str]) -> Callable[[pa.Table], pa.Table]:
    return lambda rows: pack_group(rows, capacity, base, own)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``; pieces of a sequence lie without gaps.

    Pieces are dealt by a hash into groups of about ``group_pieces`` rows, each packed best-fit decreasing in one task. A group whose
    number of sequences meets its lower bound is certified. All sequences with room of the groups with a gap are opened again, and of the
    certified ones those at most half full, which may still go together with others: their pieces are dealt anew over fewer
    groups, thus exchanged between groups, and packed again, as long as that saves sequences. Every round is a written table, so lost executors repeat one round at most. Columns of
    the input other than ``sequence_id`` and ``offset`` are kept; an empty table gives an empty one.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    # A number of its own deals equal pieces to different groups.
    spread, *own = free_names(pieces, "_spread", "_group", "_open", "_first")
    group, open_, first_ = own
    pieces = pieces.withColumn(spread, F.monotonically_increasing_id())
    loose, done, before = stored(pieces, "pieces"), None, None
    for turn in range(max_rounds):
        n = loose.count()
        n_groups = max(1, -(-n // group_pieces))
        deal = F.pmod(F.xxhash64(F.lit(turn), spread), F.lit(n_groups)).cast("long")
        base = turn << 56
        grouped = loose.withColumn(group, deal)
        extra = f"`{group}` long, sequence_id long, offset long, `{open_}` boolean, `{first_}` boolean"
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in loose.schema]) + ", " + extra

        packed = stored(grouped.groupBy(group).applyInArrow(_packer(capacity, base, own), schema), f"packed-{turn}")
        sequences = packed.where(F.col(first_))
        total, opened = sequences.agg(F.count(F.lit(1)), F.count(F.when(F.col(open_), 1))).first()
        if before is not None and total >= before[0]:
            # The exchange saved nothing: the packing before it stands.
            packed = before[1]
            return done.unionByName(packed.select(*names, "sequence_id", "offset"))
        final = packed.where(~F.col(open_)).select(*names, "sequence_id", "offset")
        done = final if done is None else done.unionByName(final)
        again = packed.where(F.col(open_))
        if not opened or n_groups == 1 or turn == max_rounds - 1:
            return done.unionByName(again.select(*names, "sequence_id", "offset"))
        before = (opened, again)
        loose = again.select(*names, spread)
    return done


def pack_documents(
    docs: DataFrame, encoder: Callable[[], object], capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Cut every document's ids into pieces of at most ``capacity`` and pack them: key, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(token_pieces(docs, encoder, capacity, end_id, key, text), capacity, group_pieces)
