import hashlib
import random

import numpy as np
import pytest
from helpers import ODD, docs, table, words

from triplewright.llm import substring_dedup as S


def brute(rows, window=13):
    first = {}
    for doc, text in rows:
        w = words(text)
        key = float("inf") if doc is None else doc
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, key), key)
    out = []
    for doc, text in rows:
        w = words(text)
        key = float("inf") if doc is None else doc
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key:
                gone |= set(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    d = table(spark, sf)
    want = brute([(r.doc_id, r.text) for r in d.collect()])
    assert sum(r[2] for r in want) > 1000
    assert got(S.removal_digest(d)) == want


@pytest.mark.parametrize("window", [2, 5, 13])
def test_random_texts(spark, window):
    rng = random.Random(window)
    pool = [[rng.choice("abcdefg") for _ in range(40)] for _ in range(6)]
    rows = [(k, " ".join(sum((rng.choice(pool)[rng.randrange(20) :] + [rng.choice("xyz")] for _ in range(rng.randrange(4))), []))) for k in range(60)]
    assert got(S.removal_digest(docs(spark, rows), window)) == brute(rows, window)


def test_odd_rows_and_cut_texts(spark):
    assert got(S.removal_digest(docs(spark, ODD))) == brute(ODD)
    d = docs(spark, [*ODD, (0, "start\n a b c d e f g h i j k l m n o p\nend")]).selectExpr("*", "1 AS n_words", "2 AS bucket", "3 AS part")
    out = {(r.doc_id, r.text) for r in S.remove_repeats(d).collect()}
    assert (0, "start\n a b c d e f g h i j k l m n o p\nend") in out
    assert (6, "") in out and (7, "") in out and (1, None) in out and (9, "x" * 20000) in out
    assert S.remove_repeats(d).columns == d.columns


def test_empty_table(spark):
    assert got(S.removal_digest(docs(spark, []))) == []


@pytest.mark.parametrize("collide", [False, True])
def test_groups_are_exact(collide):
    line = b"a b c a b c abc b c a bb c"
    text, at = np.frombuffer(line + bytes(8), np.uint8), S.word_starts(np.frombuffer(line, np.uint8))
    starts, ends = at[:-3], at[3:] - 1
    h = np.zeros(len(starts), np.uint64) if collide else S.hashes(text, starts, ends)
    order, first = S.groups(text, h, starts, ends)
    found = sorted(sorted(line[starts[k] : ends[k]] for k in g) for g in np.split(order, first[1:]))
    words = line.split()
    want = sorted(b" ".join(words[k : k + 3]) for k in range(len(words) - 2))
    assert found == sorted([w for w in want if w == x] for x in set(want))


def test_blocks_change_nothing(monkeypatch):
    line = b" ".join(str(k * k % 97).encode() for k in range(4000))
    at = S.word_starts(np.frombuffer(line, np.uint8))
    whole = S.runs(line, at, 13)
    monkeypatch.setattr(S, "BLOCK_BYTES", 100)
    assert all((a == b).all() for a, b in zip(whole, S.runs(line, at, 13), strict=True))


def test_frequent_minimisers_split_and_change_nothing(spark, sf, monkeypatch):
    import numpy as np

    d = table(spark, sf)
    rows = [(r.doc_id, r.text) for r in d.collect()] + [(5000 + k, " ".join(f"a{k} b{k + j} in the of it c{k * j % 7}" for j in range(40))) for k in range(50)]
    plain = sorted(map(tuple, S.removal_digest(docs(spark, rows)).collect()))
    found = S.frequent_minimisers(docs(spark, rows), "text", 13, 0, one_in=1)
    assert not len(found)
    monkeypatch.setattr(S, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(S, "ONE_IN", 1)
    found = S.frequent_minimisers(docs(spark, rows), "text", 13, 0, one_in=1)
    assert len(found) > 3 and (np.diff(found.astype(float)) > 0).all()
    assert sorted(map(tuple, S.removal_digest(docs(spark, rows)).collect())) == plain
    line = rows[-1][1].encode()
    at = S.word_starts(np.frombuffer(line, np.uint8))
    assert len(S.runs(line, at, 13, found)[0]) >= len(S.runs(line, at, 13)[0])


def test_clashing_columns_pass_through(spark):
    text = " ".join(f"w{k}" for k in range(20))
    d = docs(spark, [(1, text), (2, text + " end")]).selectExpr("*", "7 AS __part", "8 AS part", "9 AS _PART", "10 AS bucket")
    out = sorted(tuple(r) for r in S.remove_repeats(d).select("doc_id", "text", "__part", "part", "_PART", "bucket").collect())
    assert out == [(1, text, 7, 8, 9, 10), (2, "end", 7, 8, 9, 10)]
