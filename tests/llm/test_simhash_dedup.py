import numpy as np
import xxhash
from helpers import ODD, docs, table, words

from triplewright.llm import simhash_dedup as S


def print_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lower)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [print_of(t) for _, t in rows]
    p = np.array(prints, np.uint64)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= 3):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        least.setdefault(find(k), []).append(doc)
    return sorted(((doc, f"{prints[k]:016x}", min((d for d in least[find(k)] if d is not None), default=None)) for k, (doc, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_whole_table(spark, sf):
    d = table(spark, sf)
    want = brute([(r.doc_id, r.text) for r in d.collect()])
    assert any(r[0] != r[2] for r in want)
    assert got(S.near_duplicates(d)) == want


def test_odd_rows(spark):
    assert got(S.near_duplicates(docs(spark, ODD).selectExpr("*", "1 AS fp", "2 AS rep"))) == brute(ODD)


def test_all_ids_of_64_bits(spark):
    ids = [-(2**63), -(2**62) - 1, -1, 0, 2**62 - 1, 2**62, 2**62 + 5, 2**62 + 6, 2**63 - 2, 2**63 - 1, None]
    rows = [(k, f"text number {n // 2 % 3} of the words") for n, k in enumerate(ids)] + [(2**62 + 9, ""), (None, None)]
    assert got(S.near_duplicates(docs(spark, rows))) == brute(rows)


def test_ids_of_text(spark):
    rows = docs(spark, [(1, "a b c d"), (2, "a b c d"), (3, "e f g h")]).selectExpr("concat('x', doc_id) AS doc_id", "text")
    assert [r[2] for r in got(S.near_duplicates(rows))] == ["x1", "x1", "x3"]
    assert sorted(r.doc_id for r in S.drop_near_duplicates(rows).collect()) == ["x1", "x3"]


def test_groups_are_bounded_and_every_pair_meets(spark):
    from triplewright.llm.components import components

    rng, most = np.random.default_rng(5), 200
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    center = base[0] ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    p = np.unique(np.concatenate([base, base ^ np.uint64(5), center]))
    prints = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "fp bigint").repartition(4)
    want = np.arange(len(p))
    for a in range(len(p)):
        b = np.flatnonzero(np.bitwise_count(p ^ p[a]) <= 3)
        S.merge(want, np.full(len(b), a), b)
    while (want != want[want]).any():
        want = want[want]
    roots = {r.node: r.root for r in components(S.forest(prints, len(p), 3, most)).collect()}
    found = [roots.get(int(x), int(x)) for x in p.view(np.int64)]
    assert len(set(found)) == len(set(want)) == len(set(zip(found, want.tolist(), strict=True)))
    tree = S.Tree(p[::40], 4, 3)
    rows = [(leaf, int(p[k].view(np.int64)), bool(g)) for leaf, mine, guest in tree.route(p) for k, g in zip(mine, guest, strict=True)]
    dealt = S.groups(spark.createDataFrame(rows, "shard int, fp bigint, guest boolean"), most)
    sizes = dealt.groupBy("shard", "block", "slice").count().collect()
    assert len(sizes) > 12 and max(r["count"] for r in sizes) <= 3 * most


def test_clashing_columns_pass_through(spark):
    d = docs(spark, [(1, "a b c d"), (2, "a b c d")]).selectExpr("*", "7 AS __key", "8 AS key", "9 AS `group`")
    assert [tuple(r)[5:] for r in S.drop_near_duplicates(d).collect()] == [(7, 8, 9)]


def test_null_ids_only(spark):
    rows = [(None, "same text here"), (None, "same text here"), (None, "x y z w v")]
    assert [r[2] for r in got(S.near_duplicates(docs(spark, rows)))] == [None] * 3
    assert S.drop_near_duplicates(docs(spark, rows)).count() == 2


def test_one_document_of_each_group_stays(spark, sf):
    d = table(spark, sf)
    want = {r[2] for r in brute([(r.doc_id, r.text) for r in d.collect()])}
    out = S.drop_near_duplicates(d)
    assert out.columns == d.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_empty_table(spark):
    assert got(S.near_duplicates(docs(spark, []))) == []
    assert S.drop_near_duplicates(docs(spark, [])).count() == 0


def test_tree_finds_all_links():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    p = np.unique(np.concatenate([base, near, near ^ np.uint64(4)]))
    want = np.arange(len(p))
    for a in range(len(p)):
        b = np.flatnonzero(np.bitwise_count(p ^ p[a]) <= 3)
        S.merge(want, np.full(len(b), a), b)
    while (want != want[want]).any():
        want = want[want]
    for leaves in (1, 5, 16):
        tree, labels = S.Tree(p[::2], leaves, 3), np.arange(len(p))
        for _, mine, guest in tree.route(p):
            S.merge(labels, mine, mine[S.link(p[mine], guest, 3)])
        while (labels != labels[labels]).any():
            labels = labels[labels]
        assert (labels == want).all()


def test_components_of_chains_and_stars(spark):
    from triplewright.llm.components import components

    links = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 160)] + [(300, 200), (200, 250), (7, 7)]
    out = {r.node: r.root for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert out == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 250: 200, 300: 200}
