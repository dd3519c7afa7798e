import re
from collections import Counter

from helpers import ODD, docs, table, words
from pyspark.sql import functions as F

from triplewright.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    chars = sum(map(len, w))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), chars, symbols, len(lines) - len(set(lines)), len(covered), failed


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_base_counts(spark, sf):
    d = table(spark, sf)
    out = {r[0]: r[1:7] for r in got(Q.quality_rules(d))}
    assert out == {r.doc_id: brute(r.text) for r in d.collect()}


def test_odd_rows(spark):
    rows = [*ODD, (20, "a b c " * 100), (21, " ".join(f"w{k} x{k % 30} y{k % 30}" for k in range(200))), (22, "z " * 49), (23, "same\nsame \nsame\n \n\nsame")]
    out = got(Q.quality_rules(docs(spark, rows).selectExpr("*", "1 AS n_words", "2 AS kept")))
    assert sorted((str(r[:7]) for r in out)) == sorted(str((k, *brute(t))) for k, t in rows)
    assert got(Q.quality_rules(docs(spark, []))) == []


def test_few_and_many_repeats_agree(spark, monkeypatch):
    rows = [(k, " ".join(f"w{(i * i) % (37 + k)}" for i in range(150))) for k in range(30)]
    a = got(Q.quality_rules(docs(spark, rows)))
    monkeypatch.setattr(Q, "FEW", 0)
    b = got(Q.quality_rules(docs(spark, rows)))
    monkeypatch.setattr(Q, "FEW", 10**6)
    assert a == b == got(Q.quality_rules(docs(spark, rows)))
    assert [r[1:7] for r in a] == [brute(dict(rows)[r[0]]) for r in a]


def test_line_rules(spark):
    prose = "An ordinary sentence with several words in it, and a full stop."
    bad = ["a### b$$$ c%%%", "| x | y | z |", "BUY THIS NOW OR NEVER!!", "Click here to go on", "All rights reserved.", "---- ....", "Home | About | Contact"]
    rows = [(k, x) for k, x in enumerate([prose, "", "  ", "R&D costs $5.", "NATO met.", "ab & cd", *bad])]
    out = {r.doc_id: r.f for r in docs(spark, rows).selectExpr("doc_id", "text").withColumn("f", Q.line_fails(__import__("pyspark.sql.functions").sql.functions.col("text"))).collect()}
    assert [out[k] for k in range(6)] == [False] * 6 and [out[k] for k in range(6, 6 + len(bad))] == [True] * len(bad)
    text = "\n".join([" ".join(f"Word{k} and then{k * k} more{k}." for k in range(i, i + 20)) for i in (0, 100)] + bad)
    d = docs(spark, [(1, text), (2, "\n".join(f"{x} {k} {k} {k}" for k in range(9) for x in bad))])
    assert [(r.doc_id, r.text) for r in Q.clean_documents(d).collect()] == [(1, "\n".join(text.split("\n")[:2]))]


def test_labels_agree(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    rows = Q.quality_rules(table(spark, big)).join(table(spark, big, "labels"), "doc_id").filter("n_words >= 50").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert sum(not r.kept for r in rows if r.quality == 0) > 0


def test_furniture_in_four_languages_and_teasers(spark):
    bad = ["Zur Startseite gehen", "Alle Rechte vorbehalten 2020", "Lire la suite ici", "Tous droits r\u00e9serv\u00e9s", "P\u00e1gina siguiente", "Aviso legal y m\u00e1s", "This was the first part of what ...", "And so on\u2026 "]
    good = ["He went on ... and came back.", "Une page ordinaire.", "Der Text endet hier."]
    rows = [(k, t) for k, t in enumerate(bad + good)]
    out = {r.doc_id: r.f for r in docs(spark, rows).select("doc_id", Q.line_fails(F.col("text")).alias("f")).collect()}
    assert [out[k] for k, _ in rows] == [True] * len(bad) + [False] * len(good)


def test_clashing_columns_pass_through(spark):
    text = " ".join(f"word{k}" for k in range(80)) + "."
    d = docs(spark, [(1, text), (2, "a")]).selectExpr("*", "7 AS __words", "8 AS __lines", "9 AS judged", "10 AS _JUDGED")
    assert [tuple(r)[5:] + (r.text,) for r in Q.clean_documents(d).collect()] == [(7, 8, 9, 10, text)]
