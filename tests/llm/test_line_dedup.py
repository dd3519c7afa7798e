import hashlib
from collections import defaultdict

import pytest
from helpers import ODD, docs

from triplewright.llm import line_dedup as L

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, min_sites, keep_first=True):
    sites, first = defaultdict(set), {}
    for doc, text, site in rows:
        for pos, line in enumerate((text or "").split("\n")):
            body = line.strip(SPACE)
            if body:
                sites[body].add(site or "")
                at = (doc is None, doc or 0, str(text), pos)
                first[body] = min(first.get(body, at), at)
    out = []
    for doc, text, site in rows:
        parts = (text or "").split("\n")
        gone = {p for p, line in enumerate(parts) if (b := line.strip(SPACE)) and len(sites[b]) >= min_sites and not (keep_first and first[b] == (doc is None, doc or 0, str(text), p))}
        kept = "\n".join(x for p, x in enumerate(parts) if p not in gone)
        out.append((doc, sum(bool(x.strip(SPACE)) for x in parts), len(gone), hashlib.md5(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("keep_first", [True, False])
def test_spread_lines_go(spark, keep_first):
    rows = [(k, f"head\n own {k}\n common  \nmiddle {k % 3}\n\ncommon\ntail", f"s{k % (12 if k % 2 else 4)}") for k in range(60)]
    rows += [(100 + k, "one site only", "s1") for k in range(40)] + [(200, None, None), (201, "", "s1"), (202, "common", None), (202, "common", None), (None, "head\nx", "s3")]
    assert got(L.line_removals(docs(spark, rows), 6, keep_first)) == brute(rows, 6, keep_first)
    assert got(L.line_removals(docs(spark, rows), 9, keep_first)) == brute(rows, 9, keep_first)


def test_exact_count_near_the_threshold(spark):
    rows = [(k * 100 + s, f"line of {k} sites", f"site{s}") for k in range(1, 41) for s in range(k)]
    want = {f"line of {k} sites" for k in range(20, 41)}
    table, _ = L.boilerplate(L.line_rows(docs(spark, rows), "doc_id", "text", "source"), 20)
    assert table.count() == len(want)


def test_odd_rows(spark):
    rows = [(k, t, "src0") for k, t in ODD]
    assert got(L.line_removals(docs(spark, rows), 1)) == brute(rows, 1)
    d = docs(spark, rows).selectExpr("*", "1 AS h", "2 AS pos", "3 AS gone", "4 AS n", "5 AS key", "6 AS __key", "7 AS _Key", "8 AS __gone")
    out = L.drop_boilerplate(d, 1, keep_first=False)
    assert {tuple(r)[5:] for r in out.collect()} == {(1, 2, 3, 4, 5, 6, 7, 8)}
    assert out.columns == d.columns and out.count() == len(ODD)
    assert {r.text for r in out.collect() if r.doc_id in (1, 4, 11)} == {None, "", "\n"}


def test_long_text_and_empty_table(spark):
    rows = [(1, "\n".join(["same"] * 20000), "a"), (2, "\n".join(["same", "other"] * 5000), "b")]
    assert got(L.line_removals(docs(spark, rows), 2)) == brute(rows, 2)
    assert got(L.line_removals(docs(spark, []))) == []
