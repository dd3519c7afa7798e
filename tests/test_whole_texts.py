"""Queries that no SQL binds to a prefix work on whole texts."""

import pytest

from triplewright.queries import QUERIES

PROSE = " ".join(f"word{k}" for k in range(900))


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("long"))
    rows = [(1, f"{PROSE}\nLong Short Memory (LSM) is named.\nLate LSM use", "en", "src0", 0), (2, f"{PROSE} tail", "en", "src0", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{home}/documents.parquet")
    return home


def test_abbreviations_of_whole_texts(spark, long_texts):
    lines = {r.doc_id: r.lines for r in QUERIES["abbrev_expand"](spark, long_texts).collect()}
    assert lines[1][-2] == "Late Long Short Memory use" and lines[1][-1].startswith("A Deep Neural Network and")
    assert lines[2][0].endswith(f"{PROSE} tail")


def test_triples_of_whole_texts(spark, long_texts):
    rows = [r for r in QUERIES["lemma_stub"](spark, long_texts).collect() if r.paper_id.startswith("2102.00001v1")]
    assert len(rows) == 150 and any("word899" in r.object for r in rows)


def test_patents_of_whole_texts(spark, long_texts):
    rows = [str(r) for r in QUERIES["patent_parse"](spark, long_texts).collect()]
    assert any("word899 tail" in r for r in rows) and any("Late LSM use" in r for r in rows)
