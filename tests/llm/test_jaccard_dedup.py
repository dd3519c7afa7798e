"""The pipeline's near-duplicate stage against brute-force Jaccard similarity over five-word shingles."""

import pytest
from helpers import ODD, docs, table, words

import corpus_pipeline
from triplewright.llm import jaccard_dedup as J


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    """Least doc_id of each group, and the number of linked pairs of different sets."""
    sets, root, linked = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}, 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                linked += sets[a] != sets[b]
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d for d in sets if find(d) == d}, linked


def kept(df):
    return sorted(r.doc_id for r in df.collect())


def test_stage_on_the_table(spark, sf):
    d = table(spark, sf)
    want, linked = brute([(r.doc_id, r.text) for r in d.collect()])
    out = corpus_pipeline.near_duplicates(spark, d, sf)
    assert linked and out.columns == d.columns
    assert kept(out) == sorted(want)


@pytest.mark.parametrize("common", [0, 50, J.COMMON])
def test_edited_copies_and_a_common_passage(spark, sf, monkeypatch, common):
    monkeypatch.setattr(J, "COMMON", max(1, common))
    monkeypatch.setattr(J, "BLOCK", 16)
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(["new" + str(k) if common and p % 50 == k % 50 else w for p, w in enumerate(base)][k % 7 :])) for k in range(60)]
    rows += [(100 + k, " ".join([f"own{k}x{i}" for i in range(20 + k)] + [f"c{i}" for i in range(30 + 4 * k)])) for k in range(60)]
    want, linked = brute(rows)
    assert linked and 1 < len(want) < len(rows)
    assert kept(corpus_pipeline.near_duplicates(spark, docs(spark, rows), sf)) == sorted(want)


def test_odd_rows_and_empty_table(spark, sf):
    out = corpus_pipeline.near_duplicates(spark, docs(spark, ODD), sf).collect()
    want, _ = brute([r for r in ODD if r[0] is not None])
    assert {r.doc_id for r in out} >= want - {7} and len(out) == len({r.doc_id for r in out})
    assert corpus_pipeline.near_duplicates(spark, docs(spark, []), sf).count() == 0


def test_prefixes_of_similar_sets_meet():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in range(1, 200):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = len(x) // 5
        y = np.sort(np.concatenate([x[drop // 2 :], rng.integers(0, 2**63, drop // 3, dtype=np.uint64)]))
        if 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)):
            for common in (x[:0], rng.permutation(x)[: n // 2]):
                assert len(np.intersect1d(J.prefix(x, 80, common), J.prefix(y, 80, common)))


def test_short_prefixes_of_hashed_sets_meet():
    import numpy as np

    rng, shorter = np.random.default_rng(4), 0
    for n in range(1, 3000, 7):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        own = rng.choice(x, len(x) - len(x) // 9, replace=False)
        y = np.unique(np.concatenate([own, rng.integers(0, 2**63, len(x) // 9, dtype=np.uint64)]))
        if 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)):
            for common in (x[:0], rng.permutation(own)[: n // 2]):
                a, b = (J.prefix(s, 80, common, J.MISS) for s in (x, y))
                assert len(np.intersect1d(a, b))
                shorter += len(a) < len(J.prefix(x, 80, common))
    assert shorter > 100


def test_slices_and_packed_sets_change_nothing(spark, sf, monkeypatch):
    import numpy as np

    for name, value in {"SLICE": 7, "BUCKET": 40, "SPOKES": 5, "BLOCK": 3}.items():
        monkeypatch.setattr(J, name, value)
    d = table(spark, sf)
    rows = [(r.doc_id, r.text) for r in d.collect()]
    rows += [(1000 + k, " ".join(f"same{i}" if i % 17 != k % 17 or i > 60 else f"own{k}x{i}" for i in range(90))) for k in range(60)]
    rows += [(2000 + k, " ".join([f"t{k}y{i}" for i in range(15)] + [f"pass{i}" for i in range(70)])) for k in range(40)]
    want, linked = brute(rows)
    assert linked and kept(corpus_pipeline.near_duplicates(spark, docs(spark, rows), sf)) == sorted(want)
    x = np.unique(np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64))
    assert (J.unpacked(J.packed(x)) == x >> np.uint64(24)).all()
    assert len(J.unpacked(J.packed(x[:0]))) == 0
