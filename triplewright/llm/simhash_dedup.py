"""Near-duplicates by SimHash fingerprints, linked through a vantage-point tree over Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, lookup, row_key, stage
from .components import components
from .tokenizer_units import segments

SAMPLE = 16_384  # fingerprints that shape the tree
SHARD = 65_536  # residents a group, and points that they are compared with
LEAF = 512


def bits_of(hashes: np.ndarray, times: np.ndarray | None = None) -> int:
    """The bits that are set in over half the hashes, each counted times; none give 0."""
    if not len(hashes):
        return 0
    times = np.ones(len(hashes), np.int64) if times is None else times
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        rows = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64)
        part = times[at : at + (1 << 15)]
        ones += rows.sum(0, dtype=np.int64)
        more = part > 1
        if more.any():
            ones += (rows[more] * (part[more] - 1)[:, None]).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > times.sum(), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles with repeats: a bit is 1 if set in over half the hashes; no words give 0."""
    from xxhash import xxh64_intdigest

    ones, total = np.zeros(64, np.int64), 0

    def add(shingles) -> None:
        nonlocal total
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64)
        total += len(hashes)
        for at in range(0, len(hashes), 1 << 15):
            ones.__iadd__(np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64))

    carry: list[bytes] = []
    for segment in segments(text.lower()):
        words = carry + segment.split()
        if len(words) >= width:
            line = b" ".join(words)
            ends = list(accumulate(len(w) + 1 for w in words))
            add([line[a : b - 1] for a, b in zip([0, *ends], ends[width - 1 :], strict=False)])
        carry = words[-(width - 1) :] if width > 1 else []
    if not total and carry:
        add([b" ".join(carry)])
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0]) if total else 0


def _fingerprints(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        prints = np.array([fingerprint(t or b"", width) for t in texts], np.uint64).view(np.int64)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(prints)], ["doc_id", "key", "fp"])


class Tree:
    """Vantage-point tree. Inside a node are the points at distance <= bound of its vantage point.

    A point's home is one leaf. It is also a guest in every other leaf that may hold points within radius: at the node
    where its way leaves theirs only inside points visit the outside, so that each pair meets once, in the home of one.
    """

    def __init__(self, sample: np.ndarray, leaves: int, radius: int, least: int = 16):
        self.radius, self.nodes, self.leaves = radius, [], 0
        self.root = self.build(sample, leaves, least)

    def build(self, points: np.ndarray, leaves: int, least: int) -> int:
        """Index of a node, or -1 - leaf."""
        found = split(points) if leaves > 1 and len(points) >= 2 * least else None
        if found is None:
            self.leaves += 1
            return -self.leaves
        vantage, bound, inside = found
        at = len(self.nodes)
        self.nodes.append(None)
        self.nodes[at] = (vantage, bound, self.build(points[inside], (leaves + 1) // 2, least), self.build(points[~inside], leaves // 2, least))
        return at

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Leaf, positions in points, and whether they are guests there."""
        todo = [(self.root, np.arange(len(points)), np.zeros(len(points), bool))]
        while todo:
            node, mine, guest = todo.pop()
            if not len(mine):
                continue
            if node < 0:
                yield -1 - node, mine, guest
                continue
            vantage, bound, inner, outer = self.nodes[node]
            to_in, in_guest, to_out, out_guest = sides(points[mine], vantage, bound, guest, self.radius)
            todo += [(inner, mine[to_in], in_guest), (outer, mine[to_out], out_guest)]


def sides(points: np.ndarray, vantage: np.uint64, bound: int, guest: np.ndarray, radius: int, among: bool = True) -> tuple[np.ndarray, ...]:
    """Who goes inside and who outside, by the triangle inequality, and who is a guest there.

    Without among only guests cross: those who are at home are not compared with each other.
    """
    d = np.bitwise_count(points ^ vantage).astype(np.int16)
    inside = d <= bound
    to_in = np.where(guest, d - radius <= bound, inside)
    to_out = np.where(guest, d + radius > bound, ~inside | (among & (d + radius > bound)))
    return to_in, guest[to_in], to_out, (guest | inside)[to_out]


def split(points: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
    """The vantage point of the widest spread among a few, a bound near the median, and who is inside; None if all are as far."""
    best = None
    for vantage in points[:: max(1, len(points) // 8)][:8]:
        d = np.bitwise_count(points ^ vantage)
        if best is None or d.var() > best[0]:
            best = d.var(), vantage, d
    _, vantage, d = best
    bound = int(np.median(d))
    if bound >= d.max():
        bound = int(d.max()) - 1
    if bound < d.min():
        return None
    return vantage, bound, d <= bound


def merge(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Union of u and v; labels point to smaller members of the same set, roots to themselves."""
    while len(u):
        a, b = labels[u], labels[v]
        while True:
            x, y = labels[a], labels[b]
            if (x == a).all() and (y == b).all():
                break
            a, b = x, y
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))


def link(points: np.ndarray, guest: np.ndarray, radius: int, among: bool = True) -> np.ndarray:
    """Labels of the sets that links within radius make; guests link to residents only, and those to each other if among."""
    labels = np.arange(len(points))
    todo = [(np.flatnonzero(~guest), np.flatnonzero(guest))]
    while todo:
        home, away = todo.pop()
        if not len(home):
            continue
        found = split(points[home]) if len(home) > LEAF else None
        if found is None:
            for a in range(0, len(home), LEAF):
                block = home[a : a + LEAF]
                others = np.concatenate([home[a:] if among else home[:0], away])
                for b in range(0, len(others), 4 * LEAF):
                    part = others[b : b + 4 * LEAF]
                    x, y = np.nonzero(np.bitwise_count(points[block][:, None] ^ points[part][None, :]) <= radius)
                    merge(labels, block[x], part[y])
            continue
        vantage, bound, _ = found
        everyone = np.concatenate([home, away])
        to_in, in_guest, to_out, out_guest = sides(points[everyone], vantage, bound, np.repeat([False, True], [len(home), len(away)]), radius, among)
        for chosen, visits in ((everyone[to_in], in_guest), (everyone[to_out], out_guest)):
            todo.append((chosen[~visits], chosen[visits]))
    while (labels != labels[labels]).any():
        labels = labels[labels]
    return labels


def _route(tree: Tree, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points = batch.column("fp").to_numpy().view(np.uint64)
        for leaf, mine, guest in tree.route(points):
            yield pa.record_batch([pa.array(np.full(len(mine), leaf, np.int32)), batch.column("fp").take(pa.array(mine)), pa.array(guest)], ["shard", "fp", "guest"])


def _link(radius: int, table: pa.Table) -> pa.Table:
    fp, away = table.column("fp").to_numpy(), table.column("away").to_numpy()
    labels = link(fp.view(np.uint64), away, radius, among=table.column("slice")[0].as_py() == 0)
    linked = np.flatnonzero(labels != np.arange(len(labels)))
    return pa.table({"u": pa.array(fp[linked]), "v": pa.array(fp[labels[linked]])})


def groups(shards: DataFrame, most: int) -> DataFrame:
    """shard, block, slice, fp and away: each shard dealt to groups of at most about most residents and most others.

    Residents are cut into blocks. In slice 0 a block is compared with itself, in each further slice with one part of
    the shard's guests or with one later block, so that every pair of the shard meets in one group whatever its size.
    """
    sizes = shards.groupBy("shard").agg(F.count_if("guest").alias("guests"), F.count_if(~F.col("guest")).alias("own"))
    up = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / most)).cast("int")
    dealt = shards.join(F.broadcast(sizes.select("shard", up("own").alias("blocks"), F.ceil(F.col("guests") / most).cast("int").alias("parts"))), "shard")
    spot = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    block, part, blocks, parts = F.col("block"), F.col("part"), F.col("blocks"), F.col("parts")
    place = lambda b, s, away: F.struct(b.alias("block"), s.cast("int").alias("slice"), F.lit(away).alias("away"))
    home = dealt.filter("NOT guest").withColumn("block", spot(blocks))
    # slices of a block: 0, one for each other part of the guests, one for each later block
    at_home = F.transform(F.sequence(F.lit(0), parts + blocks - 1 - block), lambda s: place(block, s, False))
    later = F.when(block > 0, F.transform(F.sequence(F.lit(0), block - 1), lambda b: place(b, parts + block - b, True))).otherwise(F.array().cast("array<struct<block:int,slice:int,away:boolean>>"))
    visits = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: place(b, part + 1, True))
    away = dealt.filter("guest").withColumn("part", spot(F.greatest(parts, F.lit(1))))
    rows = [home.select("shard", "fp", F.explode(F.concat(at_home, later)).alias("p")), away.select("shard", "fp", F.explode(visits).alias("p"))]
    return rows[0].unionByName(rows[1]).select("shard", "p.*", "fp")


def forest(prints: DataFrame, distinct: int, radius: int, most: int = SHARD) -> DataFrame:
    """u, v: a spanning forest of the links within radius among distinct fingerprints (fp)."""
    sample = [r[0] for r in prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    tree = Tree(np.array(sample, np.int64).view(np.uint64), max(1, -(-distinct // most)), radius)
    shards = stage(prints.select("fp").mapInArrow(partial(_route, tree), "shard int, fp bigint, guest boolean"), "shards")
    return groups(shards, most).groupBy("shard", "block", "slice").applyInArrow(lambda t: _link(radius, t), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row.

    Fingerprints are SimHashes of lower-cased (A-Z) word shingles; they link at radius or fewer differing bits, and
    component_id is the smallest doc_id that a document reaches through links, itself included. Distinct fingerprints
    are dealt to the leaves of a vantage-point tree that a sample of SAMPLE fingerprints shapes; points near a border
    also visit the leaves beyond it, so all pairs are compared exactly. Full leaves are cut into groups of bounded
    size. Each group emits a spanning forest of its links, never its pairs, and the components of all forests are
    found over tables.
    Links are between fingerprints, so ids may be of any type that has an order, and of any value. Null and empty texts
    have fingerprint zero and link like any other. Null ids never become a component_id, and a component without any
    id has a null one. Repeated rows are kept. An empty table gives an empty result.
    with_key adds key (of equal rows) and group (never null).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    prints = stage(plain.mapInArrow(partial(_fingerprints, width), f"doc_id {kind}, key bigint, fp bigint"), "fingerprints")
    total = prints.count()
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    distinct = nodes.count()
    roots = components(forest(nodes, distinct, radius))
    named = stage(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("group")), "named")
    ids = named.groupBy("group").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = stage(lookup(named.drop("least"), ids, "group", "members", distinct), "components")
    out = lookup(prints, named, "fp", "n", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *(["key", "group"] if with_key else []))


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with the row of the smallest doc_id (null ids last) of each group of found (doc_id, key, group); of repeated rows one."""
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    key = free(docs, "key")
    keys = stage(first.select(F.col("first.key").alias(key)), "survivors")
    kept = docs.withColumn(key, row_key(id_col, text_col)).join(keys.hint("merge"), key, "left_semi")
    repeated = found.groupBy("key").count().filter("count > 1").limit(1).count()
    return (kept.dropDuplicates([key]) if repeated else kept).drop(key)


def drop_near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, percent: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id (null ids last).

    Without percent groups are the components of near_duplicates(). With percent, documents are linked if the Jaccard
    similarity of their sets of word shingles is that or more: links of fingerprints are then proposals that are
    verified, and so are those of jaccard_dedup.similar_documents(), which finds the pairs whose fingerprints are
    further apart than radius.
    All columns are kept. Of repeated rows one stays.
    """
    if percent is None:
        return one_of_each(docs, near_duplicates(docs, width, radius, id_col, text_col, with_key=True), id_col, text_col)
    from .jaccard_dedup import similar_documents

    return one_of_each(docs, stage(similar_documents(docs, width, percent, radius, id_col, text_col), "groups"), id_col, text_col)
