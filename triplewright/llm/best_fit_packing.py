"""Packing token sequences by patterns of few documents, fitted by non-negative least squares."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, tidy
from .byte_level import ByteLevelIds

MIN_SLICE = 256
_open: dict[str, ByteLevelIds] = {}


def _pieces(path: str, end_id: int, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    units = _open.get(path) or _open.setdefault(path, ByteLevelIds(path))
    end = end_id.to_bytes(4, "little")
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        rows, piece, start, length, crc = [], [], [], [], []
        for row, ids in enumerate(units.encode(texts)):
            ids += end
            n = len(ids) // 4
            at, k = 0, 0
            while at < n:  # only the first piece may be shorter
                to = at + ((n - at) % size or size)
                rows.append(row)
                piece.append(k)
                start.append(at)
                length.append(to - at)
                crc.append(zlib.crc32(ids[4 * at : 4 * to]))
                at, k = to, k + 1
        yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
    tidy()


def patterns(lengths: np.ndarray, size: int, depth: int = 3) -> np.ndarray:
    """All ways to fill size exactly with 2 to depth (at most 3) of these lengths, one a row, 0 for no third length."""
    there = np.zeros(size + 1, bool)
    there[lengths[(lengths > 0) & (lengths < size)]] = True
    a = np.flatnonzero(there)
    pairs = a[(2 * a <= size) & there[size - a]]
    found = [np.stack([pairs, size - pairs, np.zeros_like(pairs)], 1)]
    if depth > 2:
        for x in a[3 * a <= size]:
            y = a[(a >= x) & (2 * a <= size - x)]
            y = y[there[size - x - y]]
            found.append(np.stack([np.full_like(y, x), y, size - x - y], 1))
    return np.concatenate(found)


def nnls(rows: np.ndarray, counts: np.ndarray, steps: int = 3000) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' use of each length near counts, in the least-squares sense.

    Greedy coordinate descent: each step moves the pattern with the steepest gradient to its best value, so few
    patterns become non-zero. counts[0] is not a length.
    """
    x = np.zeros(len(rows))
    if not len(rows):
        return x
    rest = counts.astype(float)
    rest[0] = 0
    same = 1.0 + (rows[:, 0] == rows[:, 1]) + (rows[:, 1] == rows[:, 2]) + (rows[:, 0] == rows[:, 2])
    norm = (rows > 0).sum(1) + 2 * np.where(same == 4, 3, same - 1)
    one, two, three = np.ascontiguousarray(rows.T)
    scale = 1 / np.sqrt(norm)
    for _ in range(steps):
        slope = rest[one] + rest[two] + rest[three]
        gain = slope * scale
        np.abs(gain, out=gain, where=x > 0)
        p = int(np.argmax(gain))
        if abs(slope[p]) < 0.5:
            break
        step = max(-x[p], slope[p] / norm[p])
        if step == 0:
            break
        x[p] += step
        np.subtract.at(rest, rows[p], step)
        rest[0] = 0
    return x


def pack_rest(counts: np.ndarray, size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over a histogram: groups of equal bins as ([(length, items a bin)], number of bins)."""
    open_bins: dict[int, list] = {}
    free: list[int] = []  # sorted keys of open_bins

    def put(room: int, group: tuple) -> None:
        if room not in open_bins:
            open_bins[room] = []
            free.insert(bisect_left(free, room), room)
        open_bins[room].append(group)

    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect_left(free, length)
            if at < len(free):
                room = free[at]
                held, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    del free[at]
            else:
                room, held, bins = size, [], -(-left // (size // length))
            each = room // length
            whole = min(bins, left // each)
            if whole:
                put(room - each * length, ([*held, (length, each)], whole))
                left -= whole * each
            if left and whole < bins:  # fewer than a bin's share are left
                put(room - left * length, ([*held, (length, left)], 1))
                whole += 1
                left = 0
            if whole < bins and held:
                put(room, (held, bins - whole))
    return [g for groups in open_bins.values() for g in groups]


def fitted(counts: np.ndarray, size: int, depth: int, filler: int) -> tuple[list[tuple[list[tuple[int, int]], int]], np.ndarray]:
    """Groups of patterns whose repeat counts are fitted to the lengths of filler or more, and the histogram that is left.

    Counts are rounded down first; then the patterns of largest remainders (a half or more) are taken once more, as
    far as pieces last. A piece of the full size is a pattern by itself.
    """
    rest = counts.astype(np.int64).copy()
    groups = [([(size, 1)], int(rest[size]))] if rest[size] else []
    rest[size] = 0
    used = rest.copy()
    used[:filler] = 0
    rows = patterns(np.flatnonzero(used), size, depth)
    x = nnls(rows, used)
    whole = np.floor(x).astype(np.int64)
    more = x - whole
    some = np.flatnonzero(x > 0)
    rounds = [(p, int(whole[p])) for p in some[np.argsort(-x[some], kind="stable")]]
    rounds += [(p, 1) for p in some[np.argsort(-more[some], kind="stable")] if more[p] >= 0.5]
    for p, wanted in rounds:
        lengths, each = np.unique(rows[p][rows[p] > 0], return_counts=True)
        times = min(wanted, int((rest[lengths] // each).min()))
        if times > 0:
            groups.append((sorted(zip(lengths.tolist(), each.tolist(), strict=True), reverse=True), times))
            rest[lengths] -= each * times
    return groups, rest


def plan(counts: np.ndarray, size: int, depth: int = 3) -> tuple[list[tuple[list[tuple[int, int]], int]], int]:
    """Bins as groups for a histogram of lengths, and how many of the pieces are in fitted patterns.

    Patterns carry every plan. Plans differ in the length below which pieces are held back as filler for the residual
    (0 to size / 4), and in the depth of patterns; the one with fewest sequences is taken, on ties that with most
    pieces in patterns. The residual is packed by best fit. All depends on the histogram only, so its size is bounded
    by the sequence size whatever the number of documents.
    """
    total = int(counts.sum())
    best: tuple | None = None
    ways = [[(2, 0)]] + [[(2, 0), (depth, size // 4)]] * (depth > 2) + [[(depth, size * k // 16)] for k in range(5) if depth > 2]
    for way in ways:
        groups, rest = [], counts
        for deep, filler in way:  # what pairs leave over may still make threes
            more, rest = fitted(rest, size, deep, filler)
            groups += more
        placed = total - int(rest.sum())
        groups += pack_rest(rest, size)
        key = (sum(g[1] for g in groups), -placed)
        if best is None or key < best[0]:
            best = key, groups
    return (best[1], -best[0][1]) if best else ([], 0)


def _slots(groups: list) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, items a bin, first sequence and offset of each run of ranks."""
    runs: dict[int, list] = {}
    used: dict[int, int] = {}
    first = 0
    for held, bins in groups:
        offset = 0
        for length, each in held:
            runs.setdefault(length, []).append((used.get(length, 0), each, first, offset))
            used[length] = used.get(length, 0) + each * bins
            offset += each * length
        first += bins
    return {length: tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) for length, found in runs.items()}


def _place(slots: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = batch.column("length").to_numpy()
        ranks = batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for length in np.unique(lengths):
            mine = np.flatnonzero(lengths == length)
            lo, each, first, base = slots[int(length)]
            run = np.searchsorted(lo, ranks[mine], "right") - 1
            into = ranks[mine] - lo[run]
            sequence[mine] = first[run] + into // each[run]
            offset[mine] = base[run] + into % each[run] * length
        keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, depth: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of each row.

    A row's ids are those of the tokenizers library without special tokens, then end_id. Rows longer than size are cut
    into pieces of size, the first of which may be shorter. Pieces are grouped by length; only the histogram (size
    numbers) goes to the driver, which enumerates patterns of 2 to depth lengths that fill a sequence, fits their
    repeat counts by non-negative least squares, rounds them and packs the residual, with the short pieces held back
    as filler, by best fit (plan()). Each piece then takes the slot of its rank within its length. Ranks are counted in salted slices, so that one length may hold any
    share of the rows.
    Null and empty texts are one piece of length 1. Repeated rows are packed each. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    base = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = stage(docs.select(id_col, text_col).mapInArrow(partial(_pieces, tokenizer, end_id, size), base), "pieces")
    counts = np.zeros(size + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # size rows at most
        counts[length] = n
    slots = _slots(plan(counts, size, depth)[0])
    each = max(MIN_SLICE, int(counts.sum()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    slices = max(1, -(-int(counts.max()) // each))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(partial(_place, slots), f"{base}, sequence_id bigint, offset bigint")
