from helpers import ODD, docs

from triplewright.llm import license_scan as L


def brute(rows, threshold=0.8):
    known = [(n, set(L.bigrams(L.normalised(t)))) for n, t in L.TEMPLATES]
    out = []
    for doc, text in rows:
        if text is None:
            continue
        lines = text.split("\n")
        for k, line in enumerate(lines):
            grams = set(L.bigrams(L.normalised(line)))
            found = sorted((-2 * len(grams & g) / (len(grams) + len(g)), n) for n, g in known if grams)
            if found and -found[0][0] >= threshold:
                out.append((doc, "line", k, found[0][1], -found[0][0]))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_notices_in_prose(spark):
    rows = [(k, f"Some prose of its own, number {k}.\n{text}\nMore prose follows here.") for k, (_, text) in enumerate(L.TEMPLATES)]
    rows += [(100, "released UNDER the  MIT license"), (101, "All rights"), (102, "Released under no MIT License of ours."), (103, "Licensed under CC BY-NC 3.0."), (104, "licensed under")]
    out = [r for r in got(L.license_scan(docs(spark, rows))) if r[1] == "line"]
    assert out == brute(rows)
    assert {r[0] for r in out} >= set(range(len(L.TEMPLATES)))


def test_wrapped_paragraphs(spark):
    words = dict(L.TEMPLATES)["isc"].split()  # the only entry of its name
    wrapped = "\n".join(" ".join(words[k : k + 6]) for k in range(0, len(words), 6))
    out = got(L.license_scan(docs(spark, [(1, f"Title line\n\n{wrapped}\n\nEnd."), (2, wrapped)])))
    assert [r[:4] for r in out if r[1] != "line"] == [(1, "paragraph", 1, "isc"), (1, "text", 0, "isc"), (2, "paragraph", 0, "isc"), (2, "text", 0, "isc")]


def test_odd_rows_and_empty_table(spark):
    out = got(L.license_scan(docs(spark, ODD).selectExpr("*", "1 AS unit", "2 AS words")))
    assert [r for r in out if r[1] == "line"] == brute(ODD)
    assert got(L.license_scan(docs(spark, []))) == []
    assert got(L.license_scan(docs(spark, ODD), templates=[("x", "word")])) == []
    twice = [(5, "Released under the MIT License.")] * 2
    assert len(got(L.license_scan(docs(spark, twice)))) == 2


MIT = [t for n, t in L.TEMPLATES if n == "mit" and len(t) > 60][:3]


def test_whole_licences_and_embedded_notices(spark):
    comment = "# " + "\n#\n# ".join("\n# ".join(p[k : k + 60] for k in range(0, len(p), 60)) for p in MIT)
    rows = [
        (1, " ".join(MIT)),
        (2, "\n\n".join(MIT)),
        (3, comment.replace("-", "")),
        (4, "Copyright (c) 2021 Jane Roe. All rights reserved. More text."),
        (5, "We like it. Released under the MIT License. So do others, as we hear from them."),
        (6, "A text without any notice. It has two sentences."),
        (7, "Released under the MIT License.\n" * 3000),
    ]
    out = got(L.license_scan(docs(spark, rows)))
    found = {(r[0], r[1], r[3]) for r in out}
    assert {(1, "line", "mit"), (2, "text", "mit"), (4, "sentence", "all-rights-reserved"), (5, "sentence", "mit"), (7, "text", "mit")} <= found
    assert any(r[0] == 3 and r[1] in ("text", "paragraph") and r[3] == "mit" for r in out)
    assert not any(r[0] == 6 for r in out)


def test_anchors_lose_nothing():
    import random

    known = [L.bigrams(L.normalised(t)) for _, t in L.TEMPLATES]
    words, rng = set(L.anchors(known, 0.8)), random.Random(2)
    assert not words & {"the", "and", "of", "to"}
    for grams in known:
        for _ in range(40):
            kept = rng.sample(grams, rng.randint(0, len(grams)))
            if 2 * len(kept) / (len(kept) + len(grams)) >= 0.8:
                assert words & {w for g in kept for w in g.split()}
        hard = [g for g in grams if not words & set(g.split())]  # the most that a text without anchors can share
        assert 2 * len(hard) / (len(hard) + len(grams)) < 0.8
