"""Exact top-k search over binary codes by multi-index hashing with growing radii."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BITS = 64


def sign_code(embedding: Column) -> Column:
    """64-bit code of the signs of an embedding: bit i is 1 if element i is above zero; null for nulls and other sizes."""
    bits = F.transform(embedding, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    code = F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    return F.when((F.size(embedding) == BITS) & ~F.exists(embedding, lambda x: x.isNull()), code)


def cuts(codes: int) -> list[tuple[int, int]]:
    """First bit and width of each segment: as many buckets a segment as there are codes, over about six.

    Segments widen with the logarithm of the codes, so that a bucket holds about as many at every size; two are the least.
    """
    width = max(4.0, math.log2(max(2, codes)) - 2.5)
    number = max(2, round(BITS / width))
    edges = [round(k * BITS / number) for k in range(number + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def flips(width: int, radius: int) -> list[int]:
    """All values of width bits with radius ones."""
    return [sum(1 << b for b in c) for c in combinations(range(width), radius)]


def _segment(code: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _keyed(number: int, value: Column) -> Column:
    return value.bitwiseOR(F.lit(number << 32).cast("bigint"))


def _least(rows: DataFrame, by: str, order: list[str], keep: int) -> DataFrame:
    """The first keep rows of each group; groups are cut to keep rows before they are shuffled."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("__place", place).filter(F.col("__place") <= keep).drop("__place")


def _bucket(number: int, own: Column) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(number).alias("segment"), _keyed(number, own.bitwiseXOR(x)).alias("key"))


def _probes(open_codes: DataFrame, segments: list[tuple[int, int]], radius: int) -> DataFrame:
    """q, kth, segment and the key of each bucket that differs from a segment of q in exactly radius bits."""
    found = []
    for a, (at, width) in enumerate(segments):
        if radius <= width:
            masks = F.split(F.lit(",".join(map(str, flips(width, radius)))), ",").cast("array<bigint>")
            own = _segment(F.col("q"), at, width)
            found.append(F.transform(masks, _bucket(a, own)))
    return open_codes.select("q", "kth", F.explode(F.concat(*found)).alias("p")).select("q", "kth", "p.*")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", code_col: str = "code") -> DataFrame:
    """query_id, rank (from 1), neighbor_id and distance of the k nearest rows of each query row, itself left out.

    rows and queries: an id (bigint) and a 64-bit code. Order is by Hamming distance, then id. Equal codes are one entry
    of the index with its k + 1 least ids, which is all that a result can need, and equal query codes are searched once.
    Codes are cut into m segments. Round r probes, for each open query, the buckets that differ from it in exactly r bits
    of a segment; then all codes within distance m * (r + 1) - 1 are known, and a query closes when its k-th verified
    distance is at most that. A pair is taken in the first round and segment that meet it, and only if its full distance
    is not above the query's k-th so far. Probes and buckets meet in a sort-merge join, in which adaptive execution
    splits a bucket that very many codes share.
    Rows with a null id or code are neither indexed nor searched; repeated rows count once. With fewer than k other rows
    all are returned. An id with several codes has an entry for each. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    clean = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(code_col).alias("code")).dropna().distinct()
    asked = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(code_col).alias("code")).dropna().distinct()
    keep = k + 1
    index = stage(_least(clean, "code", ["id"], keep).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    codes, entries = index.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    segments = cuts(codes)
    m, enough = len(segments), min(keep, entries)
    keys = F.array(*(_keyed(a, _segment(F.col("code"), at, width)) for a, (at, width) in enumerate(segments)))
    buckets = index.select("code", "ids", F.explode(keys).alias("key"))
    open_codes = stage(asked.select(F.col("code").alias("q"), F.lit(BITS).alias("kth")).distinct(), "open")
    state = spark.createDataFrame([], "q bigint, d int, id bigint")
    done = state
    for radius in range(max(w for _, w in segments) + 1):
        apart = [F.bit_count(_segment(F.col("q").bitwiseXOR(F.col("code")), at, width)) for at, width in segments]
        # met before: a smaller difference in any segment, or the same one in an earlier segment
        first = ~F.greatest(F.lit(False), *((apart[a] < radius) | ((F.lit(a) < F.col("segment")) & (apart[a] == radius)) for a in range(m)))
        dealt = open_codes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "q")  # each code makes very many probes
        hits = _probes(dealt, segments, radius).join(buckets.hint("merge"), "key").withColumn("d", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("int"))
        fresh = hits.filter((F.col("d") <= F.col("kth")) & first).select("q", "d", F.explode("ids").alias("id"))
        state = stage(_least(state.unionByName(fresh), "q", ["d", "id"], keep), "nearest")
        bound = m * (radius + 1) - 1
        kth = state.groupBy("q").agg(F.when(F.count(F.lit(1)) >= enough, F.max("d")).otherwise(BITS + 1).alias("kth"))
        judged = stage(open_codes.select("q").join(kth, "q", "left").select("q", F.coalesce("kth", F.lit(BITS + 1)).alias("kth")), "judged")
        closed = (F.col("kth") <= bound) | F.lit(bound >= BITS)
        done = done.unionByName(state.join(judged.filter(closed).select("q"), "q", "left_semi"))
        open_codes = judged.filter(~closed)
        if not open_codes.limit(1).count():
            break
        state = state.join(open_codes.select("q"), "q", "left_semi")
    pairs = asked.join(done.select(F.col("q").alias("code"), "d", F.col("id").alias("neighbor_id")), "code").filter("neighbor_id <> id")
    rank = F.row_number().over(Window.partitionBy("id", "code").orderBy("d", "neighbor_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "neighbor_id", F.col("d").alias("distance"))
