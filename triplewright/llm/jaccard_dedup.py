"""Near-duplicates by Jaccard similarity of word shingles, for pairs whose SimHash fingerprints are too far apart to be searched.

At a similarity of 0.8 fingerprints of 64 bits differ in about ten bits, and no tree over them prunes at that radius.
So links of fingerprints are only the first proposals here; all others come from prefixes of shingle sets, and every
proposal is verified on whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, release, row_key, stage, tidy
from .components import components
from .simhash_dedup import bits_of, forest
from .tokenizer_units import segments

WIDTH, PERCENT = 5, 80
SAMPLE = 2_048  # documents whose shingles say which are common
COMMON = 32_768  # common shingles that are told to the tasks; only the order of prefixes depends on them
MISS = 1e-12  # chance, over the hashes, that the prefix of one set of a similar pair holds no shingle of the other
BITS = 512  # of the parity map of a set
BLOCK = 512
SLOTS = 1 << 23  # bits that say which keys a pass over the texts is to read
SLICE = 4_096  # holders of a shared shingle in one group
BUCKET = 50_000  # holders of shared shingles in one task's group
SPOKES = 256  # sets that one group compares with a hub
PACKED = 5  # bytes that are kept of a shingle's hash when whole sets are compared


def shingles(text: bytes, width: int = WIDTH, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased (A-Z) word shingles: distinct ones, sorted, and how often each occurs; all words are one shingle if there are fewer than width."""
    from xxhash import xxh64_intdigest

    found, carry = [np.empty(0, np.uint64)], []
    for segment in segments(text.lower()):
        words = carry + segment.split()
        if len(words) >= width:
            line = b" ".join(words)
            ends = list(accumulate(len(w) + 1 for w in words))
            found.append(np.fromiter(map(xxh64_intdigest, (line[a : b - 1] for a, b in zip([0, *ends], ends[width - 1 :], strict=False)), repeat(seed)), np.uint64))
        carry = words[-(width - 1) :] if width > 1 else []
    if len(found) == 1 and carry:
        found.append(np.array([xxh64_intdigest(b" ".join(carry), seed)], np.uint64))
    return np.unique(np.concatenate(found), return_counts=True)


def prefix(hashes: np.ndarray, percent: int, common: np.ndarray, miss: float = 0.0) -> np.ndarray:
    """The first shingles of a set in an order common to all sets: rare ones by their hashes, then common ones.

    Of two sets of percent similarity the first shingle that both hold is in the prefix of each: a set of n shares all
    but a = n * (100 - percent) / 100 at most, so its first a + 1 meet it for certain. Among m rare shingles, which
    hashes put in random order, the first k are all among those a with a chance of (a / m) ** k at most. With miss
    above 0 a prefix ends where this chance falls below miss.
    """
    size = len(hashes)
    if not size:
        return hashes
    at = np.zeros(size, np.int64)
    if len(common):
        order = np.argsort(common)
        place = np.minimum(np.searchsorted(common, hashes, sorter=order), len(common) - 1)
        at = np.where(common[order[place]] == hashes, len(common) - order[place], 0)
    apart = size - -(-percent * size // 100)
    take, rare = apart + 1, int((at == 0).sum())
    if miss and 0 < apart < rare:
        enough = math.ceil(math.log(miss) / math.log(apart / rare))
        if enough <= rare:
            take = min(take, enough)
    return hashes[np.lexsort((hashes, at))][:take]


def parity(hashes: np.ndarray) -> bytes:
    """Whether an odd number of hashes falls on each bit: maps differ in no more bits than their sets have elements apart."""
    return np.packbits((np.bincount((hashes % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(bool)).tobytes()


def packed(hashes: np.ndarray) -> bytes:
    """The upper PACKED bytes of each hash; two unequal hashes agree on them once in 2 ** 40 pairs."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, 8 - PACKED :]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // PACKED, 8), np.uint8)
    wide[:, :PACKED] = np.frombuffer(data, np.uint8).reshape(-1, PACKED)
    return wide.view(np.uint64).ravel()


def _sample(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            yield pa.record_batch([pa.array(shingles(text or b"", width)[0].view(np.int64))], ["token"])


def _prints(width: int, percent: int, common: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        sets, prints, sizes, bits, firsts = [], [], [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            hashes, times = shingles(text or b"", width)
            sets.append(xxh3_64_intdigest(hashes.tobytes()))
            prints.append(bits_of(hashes, times))
            sizes.append(len(hashes))
            bits.append(parity(hashes))
            firsts.append(prefix(hashes, percent, common, MISS).view(np.int64))
        prefixes = pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, firsts))], pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *firsts])))
        numbers = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sets, prints)]
        yield pa.record_batch([batch.column("doc_id"), batch.column("key"), *numbers, pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), prefixes], ["doc_id", "key", "node", "fp", "size", "bits", "prefix"])
    tidy()


def _sets(width: int, slots: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of rows whose key has its slot marked, once a batch; other keys may share that slot."""
    for batch in batches:
        keys, first = np.unique(batch.column("key").to_numpy(), return_index=True)
        at = keys & (SLOTS - 1)
        marked = slots[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
        mine = pa.array(first[marked])
        found = [packed(shingles(t or b"", width)[0]) for t in batch.column("text").take(mine).cast(pa.binary()).to_pylist()]
        yield pa.record_batch([pa.array(keys[marked]), pa.array(found, pa.binary())], ["key", "hashes"])
    tidy()


def _may(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that sizes and parity maps allow to be similar."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("u_bits", "v_bits"))
        size, other = (batch.column(c).to_numpy().astype(np.int64) for c in ("u_size", "v_size"))
        near = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) * (100 + percent) <= (size + other) * (100 - percent)
        good = near & (100 * np.minimum(size, other) >= percent * np.maximum(size, other))
        yield pa.record_batch([batch.column("u"), batch.column("v")], ["u", "v"]).take(pa.array(np.flatnonzero(good)))


def _verify(percent: int, table: pa.Table) -> pa.Table:
    """Links of a hub with the sets that were sent to one of its slices."""
    hub = table.column("hub").to_numpy(zero_copy_only=False)
    u, v = table.column("u").to_numpy(), table.column("node").to_numpy()
    data, good = table.column("hashes"), []
    x = unpacked(data[int(np.flatnonzero(hub)[0])].as_py()) if hub.any() else np.empty(0, np.uint64)
    for k in np.flatnonzero(~hub):
        y = unpacked(data[int(k)].as_py())
        both = len(np.intersect1d(x, y, assume_unique=True))
        if 100 * both >= percent * (len(x) + len(y) - both):
            good.append(int(k))
    return pa.table({"u": pa.array(u[good]), "v": pa.array(v[good])})


def _apart(percent: int, table: pa.Table) -> pa.Table:
    """Pairs that share a shingle, are of different components and may be similar by their sizes and parity maps."""
    token, slot, node, size, root, away = (table.column(c).to_numpy(zero_copy_only=False) for c in ("token", "slice", "node", "size", "root", "away"))
    size = size.astype(np.int64)
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
    order = np.lexsort((size, slot, token))
    cuts = np.flatnonzero(np.diff(token[order]) | np.diff(slot[order])) + 1
    seen: list[np.ndarray] = []
    for mine in np.split(order, cuts):
        home = mine[~away[mine]]
        for a in range(0, len(home), BLOCK):
            x = home[a : a + BLOCK]
            lo = np.searchsorted(size[mine], -(-percent * size[x[0]] // 100), "left")
            others = mine[lo : np.searchsorted(size[mine], size[x[-1]] * 100 // percent, "right")]
            for b in range(0, len(others), BLOCK):
                y = others[b : b + BLOCK]
                i, j = np.nonzero((root[x][:, None] != root[y][None, :]) & (100 * np.minimum(size[x][:, None], size[y][None, :]) >= percent * np.maximum(size[x][:, None], size[y][None, :])))
                i, j = x[i], y[j]
                differ = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
                may = differ * (100 + percent) <= (size[i] + size[j]) * (100 - percent)
                i, j = node[i[may]], node[j[may]]
                if len(i):
                    seen.append(np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], 1), axis=0))
    pairs = np.unique(np.concatenate(seen), axis=0) if seen else np.empty((0, 2), np.int64)
    return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})


def _links(pairs: DataFrame, nodes: DataFrame, plain: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """The staged pairs of nodes whose sets are as similar as percent, compared whole.

    A hub u is sent to one slice for every SPOKES of its partners. Sets are made of the texts once more, travel by key
    to their slices and are not stored.
    """
    spokes = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    slices = F.ceil(F.col("n") / SPOKES).cast("int")
    total = pairs.count()
    hubs = spokes.select(F.col("u").alias("node"), "u", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.lit(True).alias("hub"))
    members = lookup(pairs, spokes.select("u", slices.alias("slices"), "n"), "u", "n", total)
    members = members.select(F.col("v").alias("node"), "u", F.pmod(F.xxhash64("v"), "slices").cast("int").alias("slice"), F.lit(False).alias("hub"))
    places = stage(hubs.unionByName(members).join(nodes.select("node", "key"), "node"), f"{name}-places")
    slot = f"(key & {SLOTS - 1})"
    marks = places.groupBy(F.expr(f"shiftright({slot}, 6)").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} & 63 AS int)))").alias("bits")).collect()
    slots = np.zeros(SLOTS // 64, np.int64)
    for word, bits in marks:  # SLOTS / 64 rows at most
        slots[word] = bits
    sets = plain.select("key", "text").mapInArrow(partial(_sets, width, slots.view(np.uint8)), "key bigint, hashes binary")
    met = sets.join(places.hint("merge"), "key").select("u", "slice", "node", "hub", "hashes")
    links = stage(met.groupBy("u", "slice").applyInArrow(lambda t: _verify(percent, t), "u bigint, v bigint").distinct(), name)
    release(pairs, places)
    return links


def _held(shared: DataFrame, named: DataFrame, total: int) -> DataFrame:
    """token, slice, away and the node's columns for shingles that several components hold.

    Holders of a shingle are dealt to slices of about SLICE. Those outside its largest component also visit all other
    slices, so that every pair of two components meets while no group is unbounded by its largest component.
    """
    holders = lookup(shared.select("token", "node"), named.select("node", "root", F.col("n_shared").alias("n")), "node", "n", total)
    split = holders.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main"))
    split = stage(split.filter("roots > 1").select("token", "n", F.col("main.root").alias("main"), F.ceil(F.col("n") / SLICE).cast("int").alias("slices")), "split")
    apart = lookup(holders, split, "token", "n", total).withColumn("own", F.pmod(F.xxhash64("node"), "slices").cast("int"))
    place = lambda s: F.struct(s.alias("slice"), (s != F.col("own")).alias("away"))
    everywhere = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), place)
    visits = F.when(F.col("root") == F.col("main"), F.array(place(F.col("own")))).otherwise(everywhere)
    rows = apart.select("token", "node", F.explode(visits).alias("p")).select("token", "node", "p.*")
    held = stage(rows.join(named.select("node", "size", "bits", "root").hint("merge"), "node"), "held")
    release(split)
    return held


def similar_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of equal rows) and group (never null) of each row.

    Two documents are linked if the Jaccard similarity of their sets of word shingles is percent or more; a group is
    what links reach. Equal sets are one node. First proposals are the links of SimHash fingerprints within radius, and
    for each node the smallest node of those with which it shares most shingles of its prefix (see prefix()). After
    these are verified, all pairs that share a shingle of their prefixes and are of different components are compared,
    but for those that sizes or parity maps prove to be less similar. Nothing is left out or capped; prefixes miss a
    similar pair with a chance of 2 * MISS over the hashes, which is that of unequal sets with equal hashes in a corpus.
    Texts without words are one group. Ids may be of any type that has an order. Repeated rows are kept. An empty table
    gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    total = docs.count()
    chosen = plain.filter(F.pmod(F.xxhash64("key"), F.lit(max(1, total // SAMPLE))) == 0)
    often = chosen.mapInArrow(partial(_sample, width), "token bigint").groupBy("token").count().filter("count > 2")
    common = [r[0] for r in often.orderBy(F.desc("count"), "token").limit(COMMON).collect()]
    common = np.array(common, np.int64).view(np.uint64)
    prints = stage(plain.mapInArrow(partial(_prints, width, percent, common), f"doc_id {kind}, key bigint, node bigint, fp bigint, size int, bits binary, prefix array<bigint>"), "prints")
    nodes = stage(prints.groupBy("node").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("fp", "size", "bits", "prefix"))), "nodes")
    tokens = nodes.select("node", F.explode("prefix").alias("token"))
    number = tokens.count()
    hubs = tokens.groupBy("token").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stage(lookup(tokens, hubs, "token", "n", number), "shared")
    best = shared.filter("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.max_by("hub", F.struct("n", -F.col("hub").cast("decimal(20,0)"))).alias("hub"))
    fps = stage(nodes.groupBy("fp").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n")), "fps")
    distinct = fps.count()
    near = forest(fps, distinct, radius)
    near = near.join(fps.select(F.col("fp").alias("u"), F.col("rep").alias("node")), "u").join(fps.select(F.col("fp").alias("v"), F.col("rep").alias("hub")), "v").select("node", "hub")
    equal = lookup(nodes.select("fp", "node"), fps.filter("n > 1"), "fp", "n", distinct).filter("node <> rep").select("node", F.col("rep").alias("hub"))
    stars = best.unionByName(near).unionByName(equal).select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    ends = [nodes.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("bits").alias(f"{c}_bits")) for c in "uv"]
    stars = stage(stars, "stars")
    spokes = stars.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    judged = lookup(stars.join(ends[1], "v"), ends[0].join(spokes, "u"), "u", "n", stars.count()).mapInArrow(partial(_may, percent), "u bigint, v bigint")
    judged = stage(judged, "pairs")
    release(stars, fps)
    links = _links(judged, nodes, plain, width, percent, "links")
    roots = components(links)
    counts = shared.groupBy("node").agg(F.count(F.lit(1)).alias("n_shared"))
    named = stage(nodes.join(counts, "node").join(roots, "node", "left").select("node", "size", "bits", "n_shared", F.coalesce("root", "node").alias("root")), "named")
    held = _held(shared, named, number)
    buckets = max(1, held.count() // BUCKET)
    rest = held.withColumn("bucket", F.pmod(F.xxhash64("token", "slice"), F.lit(buckets)))
    pairs = stage(rest.groupBy("bucket").applyInArrow(lambda t: _apart(percent, t), "u bigint, v bigint").distinct(), "across")
    release(held, shared, named)
    found = _links(pairs, nodes, plain, width, percent, "links-across")
    if found.limit(1).count():  # components so far are stars already
        stars = roots.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        roots = components(stars.unionByName(found))
    groups = nodes.join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("group"))
    return lookup(prints.select("doc_id", "key", "node"), groups, "node", "n", total).select("doc_id", "key", "group")
