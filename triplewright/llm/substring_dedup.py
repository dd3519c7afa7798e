"""Repeated passages across documents, found by super-k-mer partitioning of word windows.

Consecutive windows of a text that share a minimiser (the least hash among their three-word groups) travel as one
packed string to the bucket of that minimiser, where sorting brings equal windows together. All windows with the same
words have the same minimiser, so each bucket decides alone. Documents are dealt to parts; a part sends a string that
many of its documents hold only once, with the least and greatest doc_id, and gets back which of its windows start in
a document with a smaller doc_id, so neither way carries a row for each occurrence of a common passage. Minimisers that
would overfill a bucket are mixed with a second one of longer groups, which spreads their windows over many buckets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, row_key, tidy

GROUP = 3  # words of a minimiser
SECOND = 6  # words of the second minimiser, which splits the buckets of frequent first ones
ONE_IN = 64  # documents that tell which minimisers are frequent; the result does not depend on them
LEAST_SHARE = 65_536  # a minimiser is frequent from one in so many bytes of all strings on, or a full bucket's
LONGEST = 512  # windows of a packed string
PART_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
NO_ID = (1 << 63) - 1
BLOCK_BYTES = 1 << 18
_MULT = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2 ** 64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2 ** 64 of ranges of bytes, from one running sum."""
    n = len(text)
    if len(_powers[0]) < n:
        for k, base in enumerate((_MULT, pow(_MULT, -1, 1 << 64))):
            grown = np.full(max(n, BLOCK_BYTES), base, np.uint64)
            grown[0] = 1
            _powers[k] = np.cumprod(grown)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=total[1:])
    return (total[ends] - total[starts]) * _powers[1][starts]


def word_starts(line: np.ndarray) -> np.ndarray:
    """Starts of words that single spaces part, and where one more would start."""
    return np.concatenate([[0], np.flatnonzero(line == 32) + 1, [len(line) + 1]])


def minimisers(text: np.ndarray, own: np.ndarray, window: int, group: int) -> np.ndarray:
    """The least hash among the groups of so many words of each window of a block of text; own: where its words start."""
    g = mixed(hashes(text, own[: len(own) - group], own[group:] - 1))
    span, width = 1, window - group + 1
    while span < width:
        step = min(span, width - span)
        g = np.minimum(g[:-step], g[step:])
        span += step
    return g


def runs(line: bytes, at: np.ndarray, window: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First windows, ends and keys of the runs of consecutive windows that share a key; at: word_starts().

    A key is a window's minimiser; where that is frequent (ascending), it is mixed with a minimiser of longer groups.
    Either depends on the window's words only, so equal windows have equal keys.
    """
    n = len(at) - window
    text = np.frombuffer(line, np.uint8)
    least = np.empty(n, np.uint64)
    begin = 0
    while begin < n:  # blocks of windows, so that a long text needs little memory
        end = min(n, max(begin + 1, int(np.searchsorted(at, at[begin] + BLOCK_BYTES)) - window))
        own = at[begin : end + window] - at[begin]
        block = text[at[begin] : at[end + window - 1] - 1]
        g = minimisers(block, own, window, min(GROUP, window))
        if frequent is not None and len(frequent):
            often = frequent[np.minimum(np.searchsorted(frequent, g), len(frequent) - 1)] == g
            if often.any():
                g[often] = mixed(g[often] ^ (minimisers(block, own, window, min(SECOND, window))[often] * np.uint64(0x9E3779B97F4A7C15)))
        least[begin:end] = g
        begin = end
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    ends = np.append(starts[1:], n)
    if (ends - starts).max() > LONGEST:
        parts = [np.arange(a, b, LONGEST) for a, b in zip(starts, ends, strict=True)]
        ends = np.concatenate([np.append(p[1:], b) for p, b in zip(parts, ends, strict=True)])
        starts = np.concatenate(parts)
    return starts, ends, least[starts]


class Part:
    """The packed strings of a part, in an order that only its rows decide."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], window: int, buckets: int, frequent: np.ndarray):
        strings: list[bytes] = []
        self.found: dict[int, tuple[np.ndarray, slice]] = {}
        docs, least, size = [], [], []
        for k in sorted(range(len(texts)), key=lambda k: (ids[k], texts[k])):
            line = b" ".join(texts[k].split())
            at = word_starts(np.frombuffer(line, np.uint8))
            if len(at) <= window:
                continue
            starts, ends, low = runs(line, at, window, frequent)
            self.found[k] = starts, slice(len(strings), len(strings) + len(starts))
            strings += [line[a:b] for a, b in zip(at[starts].tolist(), (at[ends + window - 1] - 1).tolist(), strict=True)]
            docs.append(np.full(len(starts), ids[k]))
            least.append(low)
            size.append(ends - starts)
        number = dict(zip(unique := list(dict.fromkeys(strings)), range(len(strings)), strict=False))
        self.strings = unique
        self.index = np.fromiter(map(number.__getitem__, strings), np.int64, len(strings))
        n = len(unique)
        self.low, self.high, self.size, bucket = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int64)
        if n:  # ids ascend
            doc = np.concatenate(docs)
            self.low[self.index[::-1]], self.high[self.index], self.size[self.index] = doc[::-1], doc, np.concatenate(size)
            bucket[self.index] = (mixed(np.concatenate(least)) % np.uint64(buckets)).astype(np.int64)
        self.by_bucket = np.argsort(bucket, kind="stable")
        self.cuts = np.searchsorted(bucket[self.by_bucket], np.arange(buckets + 1))


def _texts(table: pa.Table, id_at: int, text_at: int) -> tuple[np.ndarray, list[bytes]]:
    ids = table.column(id_at).cast(pa.int64()).fill_null(NO_ID).to_numpy()
    return ids, [t or b"" for t in table.column(text_at).cast(pa.binary()).to_pylist()]


def _send(id_at: int, text_at: int, window: int, buckets: int, frequent: np.ndarray, table: pa.Table) -> pa.Table:
    import zstandard

    part = Part(*_texts(table, id_at, text_at), window, buckets, frequent)
    press = zstandard.ZstdCompressor(level=3).compress
    rows: dict[str, list] = {"bucket": [], "part": [], "strings": [], "sizes": [], "low": [], "high": []}
    number = table.column(table.num_columns - 1)[0].as_py()
    for bucket in np.flatnonzero(np.diff(part.cuts)).tolist():
        own = part.by_bucket[part.cuts[bucket] : part.cuts[bucket + 1]]
        rows["bucket"].append(bucket)
        rows["part"].append(number)
        rows["strings"].append(press(b" ".join([part.strings[i] for i in own])))
        for name, values in (("sizes", part.size), ("low", part.low), ("high", part.high)):
            rows[name].append(press(values[own].tobytes()))
    return pa.table([pa.array(rows["bucket"], pa.int32()), pa.array(rows["part"], pa.int32()), *(pa.array(rows[k], pa.binary()) for k in ("strings", "sizes", "low", "high"))], list(rows))


def equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ranges of size bytes from a and from b hold the same bytes; 8 bytes or more must follow the ranges."""
    eight = np.ndarray((len(text) - 7,), np.uint64, text, strides=(1,))
    same, k, live = np.ones(len(a), bool), 0, np.flatnonzero(size > 0)
    while len(live):
        rest = size[live] - k
        differ = eight[a[live] + k] ^ eight[b[live] + k]
        part = rest < 8
        differ[part] &= (np.uint64(1) << (8 * rest[part]).astype(np.uint64)) - np.uint64(1)
        same[live] &= differ == 0
        k += 8
        live = live[rest > 8]
    return same


def groups(text: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows (ranges of text with hashes h), and where in it each group of equal windows starts."""
    order = np.argsort(h, kind="stable")
    near = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    a, b = order[near], order[near + 1]
    size = ends - starts
    if (size[a] == size[b]).all() and equal(text, starts[a], starts[b], size[a]).all():
        first = np.ones(len(order), bool)
        first[near + 1] = False
        return order, np.flatnonzero(first)
    raw = text.tobytes()  # two different windows share a hash: number the windows themselves
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(raw[x:y], len(number)) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)])
    order = np.argsort(which, kind="stable")
    return order, np.concatenate([[0], np.flatnonzero(np.diff(which[order])) + 1])


def _decide(window: int, table: pa.Table) -> pa.Table:
    """For each part that sent strings here: runs of windows that a smaller doc_id than the greatest of the part has."""
    import zstandard

    pull = zstandard.ZstdDecompressor().decompress
    texts, h, starts, ends, sizes, low, high, counts, base = [], [], [], [], [], [], [], [], 0
    parts = table.column("part").to_pylist()
    by_part = sorted(range(len(parts)), key=parts.__getitem__)
    for k in by_part:
        line = np.frombuffer(pull(table.column("strings")[k].as_py()), np.uint8)
        size = np.frombuffer(pull(table.column("sizes")[k].as_py()), np.int32).astype(np.int64)
        word = np.arange(size.sum()) + np.repeat(np.arange(len(size)) * (window - 1), size)
        at = word_starts(line)
        a, b = at[word], at[word + window] - 1
        h.append(hashes(line, a, b))
        starts.append(a + base)
        ends.append(b + base)
        texts.append(line)
        base += len(line)
        sizes.append(size)
        low.append(np.frombuffer(pull(table.column("low")[k].as_py()), np.int64))
        high.append(np.frombuffer(pull(table.column("high")[k].as_py()), np.int64))
        counts.append(len(size))
    size = np.concatenate(sizes)
    owner = np.repeat(np.arange(len(size)), size)  # the string of each window
    within = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
    order, starts = groups(np.concatenate([*texts, np.zeros(8, np.uint8)]), np.concatenate(h), np.concatenate(starts), np.concatenate(ends))
    del texts, h, ends
    least = np.minimum.reduceat(np.concatenate(low)[owner][order], starts)
    smallest = np.empty(len(owner), np.int64)
    smallest[order] = np.repeat(least, np.diff(np.append(starts, len(owner))))
    hit = np.flatnonzero(smallest < np.concatenate(high)[owner])
    if len(hit):  # windows of one string with the same smallest id, one after another, make one entry
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0) | (np.diff(smallest[hit]) != 0)
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(hit)))
        hit = hit[begin]
    else:
        length = hit
    press = zstandard.ZstdCompressor(level=3).compress
    bounds = np.searchsorted(owner[hit], np.concatenate([[0], np.cumsum(counts)]))
    base = np.concatenate([[0], np.cumsum(counts)])
    rows: dict[str, list] = {"part": [], "bucket": [], "runs": []}
    bucket = table.column("bucket")[0].as_py()
    for n, k in enumerate(by_part):
        own = slice(bounds[n], bounds[n + 1])
        if bounds[n] < bounds[n + 1]:
            rows["part"].append(parts[k])
            rows["bucket"].append(bucket)
            rows["runs"].append(press(np.stack([owner[hit[own]] - base[n], within[hit[own]], length[own], smallest[hit[own]]]).tobytes()))
    return pa.table([pa.array(rows["part"], pa.int32()), pa.array(rows["bucket"], pa.int32()), pa.array(rows["runs"], pa.binary())], list(rows))


def _cut(id_at: int, text_at: int, window: int, buckets: int, frequent: np.ndarray, digest: bool, docs: pa.Table, verdicts: pa.Table) -> pa.Table:
    import zstandard

    pull = zstandard.ZstdDecompressor().decompress
    ids, texts = _texts(docs, id_at, text_at)
    n_removed = np.zeros(len(texts), np.int64)
    covers: dict[int, np.ndarray] = {}
    if verdicts.num_rows:
        part = Part(ids, texts, window, buckets, frequent)
        entries = []
        for bucket, packed in zip(verdicts.column("bucket").to_pylist(), verdicts.column("runs").to_pylist(), strict=True):
            found = np.frombuffer(pull(packed), np.int64).reshape(4, -1).copy()
            found[0] = part.by_bucket[part.cuts[bucket] + found[0]]
            entries.append(found)
        string, offset, length, smallest = np.concatenate(entries, 1)
        order = np.argsort(string, kind="stable")
        string, offset, length, smallest = string[order], offset[order], length[order], smallest[order]
        first = np.searchsorted(string, np.arange(len(part.strings) + 1))
        many = np.diff(first)
        for k, (starts, own) in part.found.items():
            mine = part.index[own]
            n = many[mine]
            if not n.any():
                continue
            run = np.repeat(np.arange(len(mine)), n)
            entry = first[mine][run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
            mark = smallest[entry] < ids[k]
            a = (starts[run] + offset[entry])[mark]
            change = np.zeros(int(starts[-1]) + LONGEST + 2 * window + 1, np.int64)
            np.add.at(change, a, 1)
            np.add.at(change, a + length[entry][mark] + window - 1, -1)
            covers[k] = np.cumsum(change) > 0
    n_words, digests, new = [], [], []
    for k, text in enumerate(texts):
        words = text.split()
        n_words.append(len(words))
        gone = covers.get(k)
        if gone is None or not gone.any():
            if digest:
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            else:
                new.append(text)
            continue
        gone = gone[: len(words)]
        n_removed[k] = int(gone.sum())
        if digest:
            digests.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone, strict=True) if not g])).hexdigest())
        else:
            kept, last = [], 0
            for m, g in zip(WORD.finditer(text), gone, strict=True):
                if not g:
                    kept.append(text[last if kept else m.start() : m.end()])
                last = m.end()
            new.append(b"".join(kept))
    if digest:
        return pa.table([docs.column(id_at), pa.array(n_words, pa.int64()), pa.array(n_removed), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
    kind = docs.schema.field(text_at).type
    changed = pa.array(new, pa.binary())
    none = docs.column(text_at).combine_chunks().is_null()
    text = pa.compute.if_else(none, pa.scalar(None, pa.binary()), changed).cast(kind)
    return docs.set_column(text_at, docs.schema.field(text_at).name, text).drop_columns([docs.schema.names[-1]])


def _weigh(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of packed strings by minimiser; equal strings of a batch count once, as they travel once a part."""
    for batch in batches:
        seen: dict[bytes, int] = {}
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            line = b" ".join((text or b"").split())
            at = word_starts(np.frombuffer(line, np.uint8))
            if len(at) > window:
                starts, ends, key = runs(line, at, window)
                for a, b, k in zip(at[starts].tolist(), (at[ends + window - 1] - 1).tolist(), key.tolist(), strict=True):
                    seen[line[a:b]] = k
        keys, where = np.unique(np.fromiter(seen.values(), np.uint64, len(seen)), return_inverse=True)
        size = np.bincount(where, np.fromiter(map(len, seen), np.int64, len(seen)), len(keys)).astype(np.int64)
        yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(size)], ["key", "size"])


def frequent_minimisers(docs: DataFrame, text_col: str, window: int, size: int, one_in: int = ONE_IN) -> np.ndarray:
    """Minimisers, ascending, whose strings would overfill a bucket, as one in one_in documents says; LEAST_SHARE bounds their number."""
    chosen = docs.filter(F.pmod(F.xxhash64(F.col(text_col), F.lit(7)), F.lit(one_in)) == 0).select(text_col)
    weights = chosen.mapInArrow(partial(_weigh, window), "key bigint, size bigint").groupBy("key").agg(F.sum("size").alias("size"))
    most = max(BUCKET_BYTES, 3 * size // LEAST_SHARE) // one_in
    return np.sort(np.array([r[0] for r in weights.filter(F.col("size") > most).collect()], np.int64).view(np.uint64))


def _tidied(result: pa.Table) -> pa.Table:
    """result of a group, whose arrays are freed by now."""
    tidy()
    return result


def _run(docs: DataFrame, id_col: str, text_col: str, window: int, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, -(-size // PART_BYTES))
    buckets = max(tasks, -(-3 * size // BUCKET_BYTES))
    frequent = frequent_minimisers(docs, text_col, window, size)
    part = free(docs, "part")
    parted = docs.withColumn(part, F.pmod(row_key(id_col, text_col), F.lit(parts)).cast("int"))
    sent = parted.groupBy(part).applyInArrow(lambda t: _tidied(_send(id_at, text_at, window, buckets, frequent, t)), "bucket int, part int, strings binary, sizes binary, low binary, high binary")
    verdicts = sent.groupBy("bucket").applyInArrow(lambda t: _tidied(_decide(window, t)), "part int, bucket int, runs binary")
    schema = T.StructType.fromDDL(f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string") if digest else docs.schema
    return parted.groupBy(part).cogroup(verdicts.groupBy("part")).applyInArrow(lambda d, v: _tidied(_cut(id_at, text_at, window, buckets, frequent, digest, d, v)), schema)


def removal_digest(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (kept words joined by one space) of each row.

    A word [^\\x20\\x09-\\x0D]+ is removed if a window of consecutive words covers it whose word sequence also starts in
    a document with a smaller doc_id; windows are judged on the input. The earliest document keeps the passage.
    Null and empty texts have no words; texts shorter than a window lose nothing. Rows with the same id count as one
    document for this comparison; ids are integers, and a null id counts as the greatest of 64 bits. An empty table
    gives an empty result.
    """
    return _run(docs.select(id_col, text_col), id_col, text_col, window, True)


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all rows and columns, with repeated words (see removal_digest) cut out of the text.

    Kept words keep the white space before them; texts that lose nothing are unchanged, null texts stay null.
    """
    return _run(docs, id_col, text_col, window, False)
