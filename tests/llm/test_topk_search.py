import random

import pytest
from pyspark.sql import functions as F

from triplewright.llm import topk_search as S


def brute(rows, queries, k):
    entries = {(i, c) for i, c in rows if i is not None and c is not None}
    out = []
    for q, code in {(i, c) for i, c in queries if i is not None and c is not None}:
        near = sorted((bin((code ^ c) & (2**64 - 1)).count("1"), i) for i, c in entries if i != q)
        seen = near[:k]
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(seen)]
    return sorted(out)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("n,k", [(400, 5), (30, 10), (6, 10), (1, 3)])
def test_equals_brute_force(spark, n, k):
    rng = random.Random(n)
    rows = [(i, signed(rng.getrandbits(64))) for i in range(n)]
    rows += [(1000 + i, signed((rows[0][1] ^ (1 << rng.randrange(64))) & (2**64 - 1))) for i in range(n // 4)]
    rows += [(2000 + i, rows[0][1]) for i in range(n // 2)] + [(None, 5), (7777, None), rows[0]]
    df = spark.createDataFrame(rows, "vec_id bigint, code bigint")
    queries = [r for r in rows if r[0] is None or r[0] % 20 == 0]
    got = sorted(tuple(r) for r in S.top_k(df, spark.createDataFrame(queries, df.schema), k).collect())
    assert got == brute(rows, queries, k)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id bigint, code bigint")
    assert S.top_k(df, df).count() == 0
    one = spark.createDataFrame([(1, 2)], df.schema)
    assert S.top_k(one, df).count() == 0 and S.top_k(one, one).count() == 0


def test_codes(spark):
    e = [1.0 if k in (0, 5, 63) else -1.0 for k in range(64)]
    df = spark.createDataFrame([(e,), ([1.0] * 3,), (None,), ([None] + e[1:],)], "embedding array<float>")
    assert [r[0] for r in df.select(S.sign_code(F.col("embedding"))).collect()] == [signed(1 | 1 << 5 | 1 << 63), None, None, None]


def test_segments_cover_the_code():
    for n in (0, 1, 50, 10_000, 10**9):
        cut = S.cuts(n)
        assert cut[0][0] == 0 and sum(w for _, w in cut) == 64 and all(a + w == b for (a, w), (b, _) in zip(cut, cut[1:], strict=False))


def test_query_leaves_out_null_and_odd_vectors(spark, tmp_path):
    from triplewright.llm.queries import op2_exact_topk_search

    one = lambda k: [1.0 if b == k else -1.0 for b in range(64)]
    rows = [(k, one(k), 1) for k in range(30)] + [(20, one(20), 1), (40, None, 1), (41, [], 1), (42, [None] + one(3)[1:], 1), (None, one(3), 1), (60, one(5), None)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in op2_exact_topk_search(spark, str(tmp_path)).collect())
    codes = {(k, 1 << k) for k in range(30)} | {(60, 1 << 5)}
    assert got == brute(codes, [(i, c) for i, c in codes if i % 20 == 0], 10)
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert op2_exact_topk_search(spark, f"{tmp_path}/none").count() == 0
