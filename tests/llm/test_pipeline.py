"""Each stage of the pipeline against brute force over what the stage before left."""

import re

import pytest
import test_jaccard_dedup
import test_line_dedup
import test_tokens
from helpers import ODD, docs, table, words

import corpus_pipeline


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    docs, out = table(spark, sf), []
    home = tmp_path_factory.mktemp("steps")
    for name, step in corpus_pipeline.STAGES:
        df = step(spark, docs, sf)
        df.write.parquet(f"{home}/{name}")
        out.append((docs, spark.read.parquet(f"{home}/{name}")))
        docs = out[-1][1]
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_names_and_columns(spark, sf, steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_dedup", "substring_dedup", "best_fit_packing"]
    columns = table(spark, sf).columns
    assert all(after.columns == columns for _, after in steps[:-1])


def test_quality_keeps_good_documents_whole(spark, sf, steps):
    before, after = map(texts, steps[0])
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert after.items() <= before.items()
    assert all(k in after for k, q in labels.items() if q == 1)
    assert sum(k not in after for k, q in labels.items() if q == 0) >= 0.7 * sum(q == 0 for q in labels.values())


def test_lines(steps):
    rows = [(r.doc_id, r.text, r.source) for r in steps[1][0].collect()]
    want = {r[0]: r[3] for r in test_line_dedup.brute(rows, 10)}
    import hashlib

    assert {k: hashlib.md5((t or "").encode()).hexdigest() for k, t in texts(steps[1][1]).items()} == want


def test_near_duplicates(steps):
    before, after = map(texts, steps[2])
    want, _ = test_jaccard_dedup.brute(sorted(before.items()))
    assert after == {k: before[k] for k in want}


def test_passages(steps):
    before, after = map(texts, steps[3])
    first = {}
    for k, t in sorted(before.items()):
        w = words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    for k, t in before.items():
        w = words(t)
        gone = {i + j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < k for j in range(13)}
        assert words(after[k]) == [x for i, x in enumerate(w) if i not in gone]
        assert gone or after[k] == t
    assert len(after) == len(before)


def test_packing(steps):
    from tokenizers import Tokenizer

    from triplewright.llm.queries import vocabulary

    library = {test_tokens.BYTE: Tokenizer.from_file(vocabulary(test_tokens.BYTE))}
    test_tokens.check_packing(steps[4][1].collect(), texts(steps[4][0]), library)


def test_run_equals_the_stages(spark, sf, steps):
    rows = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, sf)) == rows(steps[4][1])


def test_other_columns_pass_through(spark, sf):
    d = table(spark, sf).limit(30).selectExpr("*", "1 AS score", "2 AS gone", "3 AS part", "4 AS key", "named_struct('a', doc_id) AS fp")
    for _, step in corpus_pipeline.STAGES[:-1]:
        d = step(spark, d, sf)
        assert re.search(r"named|score", ",".join(d.columns)) and d.columns[-1] == "fp"
    assert all(r.fp.a == r.doc_id for r in d.collect())


def folder(spark, path, rows, labels):
    docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_over_odd_and_empty_tables(spark, tmp_path):
    """Null ids and texts, repeated rows and no labels: without a model every score is one half and all documents go on."""
    odd = folder(spark, tmp_path / "odd", [*ODD, (None, None), (None, "a b c"), (None, "a b c")], [])
    rows = corpus_pipeline.run(spark, odd).collect()
    assert all(r.length > 0 for r in rows)
    assert {r.doc_id for r in rows} >= {4, 8, 9, 10, 11}  # texts of their own; one stands for all without words
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    empty = folder(spark, tmp_path / "empty", [], [(1, 1, 0)])
    assert corpus_pipeline.run(spark, empty).count() == 0
