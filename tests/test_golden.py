"""Small cases with results derived by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from triplewright.config import DISTANCES, Loading
from triplewright.functions import abbreviations, batching
from triplewright.functions import patents as PF
from triplewright.functions import text as X
from triplewright.functions import triples as TF
from triplewright.operators import inference, keyterms, memory, patents, selection, vocabulary
from triplewright.operators import triples as T
from triplewright.plans import pipelines
from triplewright.sources import readers, writers
from triplewright.streaming import incremental


@pytest.fixture(scope="module")
def value(spark):
    return lambda c: spark.range(1).select(c.alias("v")).first().v


def triples(spark, rows):
    return spark.createDataFrame([("p", k, *r) for k, r in enumerate(rows)], "paper_id string, pos int, subject string, predicate string, object string")


@pytest.mark.parametrize(
    "answer,found",
    [
        ("[(turing test; proposed in; 1950s), (human; explored; language intelligence)]", [("turing test", " proposed in", " 1950s"), ("human", " explored", " language intelligence")]),
        ("(a; b; c; d) x (x (y; z; w)", [("a; b", " c", " d"), ("x (y", " z", " w")]),
        ("(a;b) (c; d; e)\n(;;x) (a; ; b)", [("a;b) (c", " d", " e"), (";;x) (a", " ", " b")]),
        ("nothing here", []),
    ],
)
def test_parse(value, answer, found):
    assert [tuple(t) for t in value(TF.parse(F.lit(answer)))] == found


@pytest.mark.parametrize(
    "f,before,after",
    [
        (X.mend_line_breaks, "beau- tiful beau-   tifully", "beautiful beautifully"),
        (X.mend_line_breaks, "é- é x- y", "éé xy"),
        (X.mend_line_breaks, "well-known - a", "well-known - a"),
        (X.strip_citations, "see [12] and (Smith, 2020) ok [llm2] (2019a)", "see  and  ok [llm2] "),
        (X.strip_citations, "(Müller 2020) [1, 2] (see 1999)", "(Müller 2020) [1, 2] "),
        (X.strip_citations, "a [56, 64, 212] [2020]", "a [56, 64, 212] "),
        (TF.plain, "naïve-bayes\t2", "nave-bayes2"),
        (TF.no_repeats, "a a b b a", "a b a"),
        (lambda c: TF.long_words(c, 3), "the cats run", "cats"),
        (lambda c: TF.lean_predicate(c, ["can", "be"]), "can be used", "used"),
        (lambda c: TF.lean_predicate(c, ["can", "be"]), " is", " is"),
        (lambda c: TF.lean_predicate(c, ["can", "be"]), "can be", ""),
        (X.base_id, "2001.00012v10.pdf", "2001.00012"),
        (X.base_id, "vaswani.pdf", "vaswani"),
        (X.period, "/data/2301/x.pdf", "2301"),
    ],
)
def test_strings(value, f, before, after):
    assert value(f(F.lit(before))) == after


def test_versions(value):
    assert value(X.version(F.lit("a v1v12.pdf"))) == 12 and value(X.version(F.lit("plain.pdf"))) is None


def test_body_and_abstract_bounds(value):
    text = "x" * 50 + " Introduction " + "y" * 30 + " Abstract " + "z" * 300 + " acknowledgement t References r"
    assert value(X.body(F.lit(text))).startswith("Introduction") and value(X.body(F.lit(text))).endswith("z ")
    assert value(X.abstract(F.lit(text), 40)) == text[text.index("Intro") :][:40]
    early = "acknowledgement " + "w" * 200 + " reference"
    assert value(X.body(F.lit(early))) == early[100 : early.index("reference")]
    assert value(X.abstract(F.lit("A" * 150), 10)) == "A" * 10 and value(X.body(F.lit("short"))) == ""


def test_et_al(value):
    lines = ["A et al.", "B et al.", "C.", "D.", "E et al."]
    assert value(X.joined_et_al(F.array(*map(F.lit, lines)))) == ["A et al. B et al. C.", "D.", "E et al."]
    assert value(X.chunks(F.array(*map(F.lit, lines)), 2)) == ["A et al. B et al.", "C. D.", "E et al."]
    assert value(X.chunks(F.array().cast("array<string>"), 2)) == []


def test_terms(value):
    assert value(X.contains_any(F.lit("An LLM"), ["llm"])) and not value(X.contains_any(F.lit("An LLM"), ["llm"], False))
    assert value(X.contains_any(F.lit(None).cast("string"), ["a"])) is False and value(X.contains_any(F.lit("a"), [])) is False


def test_abbreviations(spark):
    lines = ["Large Language Models (LLM) help.", "An LLM, LLMs and llm; LLM."]
    df = spark.createDataFrame([(lines,), (None,)], "l array<string>")
    rows = df.select(abbreviations.expanded(F.col("l")).alias("e"), abbreviations.abbreviations(F.col("l")).alias("a")).collect()
    assert rows[0].e[1] == "An Large Language Models, LLMs and Large Language Models; Large Language Models."
    assert [tuple(x) for x in rows[0].a] == [("LLM", "Large Language Models")] and rows[1].e is None
    assert abbreviations.expand("a.b c+", {"c+": "x"}) == "a.b x"  # quoted
    assert abbreviations.expand("ABAB", {"AB": "x"}) == "ABAB"  # letters touch
    assert abbreviations.expand("1-1-", {"1-": "x"}) == "x1-"  # adjacent


def test_cleaning(spark):
    rows = [("The Deep NETWORK", " is", "good-model 42 x1"), ("the of", "a", "network"), ("big word word", "has been very much used by them all too", "thing"), ("long", "can be used", "a b")]
    out = [tuple(r)[2:] for r in T.cleaned(triples(spark, rows)).collect()]
    assert out == [("deep network", " is", "good-model")]
    assert T.nested(triples(spark, rows)).first().triplets[1].subject == "the of"
    assert T.flat(T.nested(triples(spark, rows))).count() == 4
    assert T.lemmatised(triples(spark, rows), str.upper).first().subject == "THE DEEP NETWORK"


def test_vocabulary_filter(spark):
    rows = [("a b", "p", "c"), ("a", "p", "c"), ("", "p", "c"), ("b", "p", "a c")]
    removal = spark.createDataFrame([("a",)], "word string")
    df = triples(spark, rows)
    kept, gone = vocabulary.kept_triples(df, removal), vocabulary.removed_triples(df, removal)
    assert sorted(r.pos for r in kept.collect()) == [0, 3] and sorted(r.pos for r in gone.collect()) == [1, 2]


def test_scores(spark):
    words = "word string, n bigint"
    corpus = spark.createDataFrame([("both", 10), ("rare", 10), ("multi-head", 5), ("7", 9), ("x", 9)], words)
    papers = spark.createDataFrame([("both", 20), ("rare", 4), ("new", 5), ("few", 4)], words)
    s = {r.term: r.score for r in vocabulary.term_scores(corpus, papers, 100, 50, 5).collect()}
    assert s == {"both": pytest.approx(math.log(4)), "rare": -math.inf, "new": math.inf, "few": -math.inf}
    vocab = spark.createDataFrame([(w,) for w in ("both", "rare", "new", "few", "multi-head")], "word string")
    scores = spark.createDataFrame(list(s.items()), "term string, score double")
    assert [r.word for r in vocabulary.lowest_words(vocab, scores, 0.5).collect()] == ["few", "rare"]
    entropy = spark.createDataFrame(list(zip("abcdefg", [0.1, 0.5, 2.0, 3.3, 9.1, 4.4, 7.7], strict=True)), "term string, entropy double")
    every = entropy.select(F.col("term").alias("word"))
    assert [r.word for r in vocabulary.high_entropy_words(every, entropy, 0.85).collect()] == ["e"]
    assert len(vocabulary.ngram_distances(DISTANCES)) == 49 - 16


def test_selection(spark):
    df = spark.createDataFrame([("a", "cs.AI cs.CL"), ("b", "math"), ("c", None)], "id string, categories string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(selection.in_categories(df, ["cs.CL"])) == ["a"] and ids(selection.in_categories(df, ["cs.CL"], True)) == ["b", "c"]
    assert ids(selection.in_categories(df, [])) == [] and ids(selection.in_categories(df, [], True)) == ["a", "b", "c"]
    assert selection.sample(df, 1, "id").count() == 1 and selection.sample(df, 0.5, "id").count() == 1 and selection.sample(df, 9, "id").count() == 3
    many = spark.range(1000).withColumnRenamed("id", "n")
    for size, n in ((0.25, 250), (0.999, 999), (1, 1), (617, 617), (1000, 1000), (5000, 1000), (0.0001, 0)):
        drawn = selection.sample(many, size, "n")
        assert drawn.columns == ["n"] and drawn.distinct().count() == n == drawn.count()
    assert selection.sample(many, 100, "n").collect() != selection.sample(many, 100, "n", seed=1).collect()
    assert T.lemmatised_text("The cats , ran .", str.lower) == "the cats ran"
    assert selection.in_language(df, ["x"], lambda t: "x" if t == "math" else 1 / 0, text="categories").count() == 1
    assert ids(selection.missing(df, df.filter("id = 'a'"), "id")) == ["b", "c"]


def test_batches_and_prompts(value):
    assert value(batching.heuristic_batch(F.lit(8), F.lit(40.0), F.lit(1000), F.lit(400))) == 20
    assert value(batching.estimated_batch(F.lit(3.0), F.lit(7.0))) == 1
    assert value(batching.answer(F.lit("x assistant y assistant z"), "meta-llama/Meta-Llama-3-8B-Instruct")) == " z"
    with pytest.raises(ValueError):
        batching.answer(F.lit("x"), "other")
    assert value(batching.role_prompt(F.lit("T"))).endswith("The first text is: \n T<|end_of_turn|>GPT4 Correct Assistant:")
    calls = []

    def model(batch):
        calls.append(len(batch))
        if len(batch) > 2 or "bad" in batch:
            raise MemoryError
        return [x.upper() for x in batch]

    assert inference.with_back_off(model, ["a", "bad", "c", "d"], 4) == ["A", None, "C", "D"] and calls[:3] == [4, 3, 2]


def test_memory(spark):
    points = [(c, float(x), s * x + 1) for c, s in (("without cache", 2.0), ("with cache", 1.0), ("cache size", 0.5)) for x in range(1, 9)]
    assert memory.needed(spark.createDataFrame(points, "curve string, x double, y double"), 10, 5) == (pytest.approx(24.5), True)
    bent = [(c, float(x), (x - 4.5) ** 2 if c == "without cache" else y) for c, x, y in points]
    assert memory.needed(spark.createDataFrame(bent, "curve string, x double, y double"), 100, 5)[0] == pytest.approx(95.5**2)


def test_codes(value):
    assert tuple(value(PF.parsed_code(F.lit("G06F 17/30")))) == ("G", "G06", "G06F", "G06F 17/30")
    assert value(PF.parsed_code(F.lit("G6F"))) is None
    none = F.lit(None).cast("string")
    assert value(PF.has_keyword(none, F.array(F.lit("a")), F.array(F.lit("b")), ["a"])) is False
    assert value(PF.has_keyword(F.lit("t"), F.array(F.lit("a")), F.array(F.lit("b")), [])) is True


PATENT = """<us-patent-{kind} file="US001-2.XML" date-produced="20200101"><us-bibliographic-data-{kind}>
<publication-reference><document-id><date>20200107</date></document-id></publication-reference>
<application-reference appl-type="utility"><document-id><doc-number>16</doc-number><date>20190101</date></document-id></application-reference>
<invention-title>A &amp;lt;b</invention-title>{codes}{related}
<us-references-cited><us-citation><patcit><document-id><country>US</country><doc-number>9</doc-number><kind>A</kind><name>N</name><date>1</date></document-id></patcit><category>cited by examiner</category></us-citation>
<us-citation><nplcit><othercit>Book</othercit></nplcit><category>cited by applicant</category></us-citation></us-references-cited>
<priority-claims><priority-claim><country>DE</country><doc-number>5</doc-number><date>2</date></priority-claim></priority-claims>
<us-parties><us-applicants><us-applicant><addressbook><orgname>Org</orgname><city>unknown</city><country>CH</country></addressbook></us-applicant></us-applicants>
<inventors><inventor><addressbook><last-name>L</last-name><first-name>F</first-name></addressbook></inventor></inventors>
<agents><agent rep-type="attorney"><addressbook><orgname>Law</orgname></addressbook></agent></agents></us-parties>
</us-bibliographic-data-{kind}><abstract>\nAbs\n</abstract><description>D</description><claims><claim>C1</claim><claim>C2</claim></claims></us-patent-{kind}>"""
IPCR = "<classifications-ipcr><classification-ipcr><section>G</section><class>06</class><subclass>F</subclass><main-group>17</main-group><subgroup>30</subgroup></classification-ipcr></classifications-ipcr>"
RELATED = "<us-related-documents><{0}><relation><parent-doc><document-id><country>US</country><doc-number>3</doc-number></document-id></parent-doc></relation></{0}></us-related-documents>"


def test_patents(spark, tmp_path):
    docs = [
        PATENT.format(kind="grant", codes=IPCR, related=RELATED.format("continuing-reissue")),
        PATENT.format(kind="application", codes="<classification-ipc><main-classification>H04L 9/32</main-classification></classification-ipc>", related=""),
        PATENT.format(kind="grant", codes="", related=RELATED.format("unheard-of")),
        "<sequence-cwu/>",
        "<us-patent-grant",
    ]
    (tmp_path / "a.xml").write_text("".join(readers.DECLARATION + "\n" + d for d in docs))
    records = patents.parsed(readers.xml_documents(spark, str(tmp_path))).cache()
    assert tuple(patents.counts(records).first()) == (2, 2, 1)
    good = {r.application_status: r for r in records.filter("error IS NULL AND NOT skipped").collect()}
    g, a = good["granted"], good["pending"]
    assert g.publication_number == "US001" and g.grant_date == "20200101" and a.grant_date is None and g.publication_title == "A <b"
    assert g.section_class_subclass_groups == ["G06F 17/30"] and a.section_class_subclass_groups == ["H04L 9/32"]
    kinds = [(r.document_type, r.reference, r.cited_by_examiner) for r in g.referential_documents]
    assert kinds == [("reissue", None, False), ("patent-reference", "9", True), ("other-reference", "Book", False), ("other-reference", "5", False)]
    assert g.referential_documents[0].metadata["application_number"] == "3"
    assert (g.authors, g.organizations, g.attorney_organizations, g.abstract, g.claims) == (["F L"], ["Org, CH"], ["Law"], ["Abs"], ["C1", "C2"])
    texts, attributes = pipelines.patents_to_texts(readers.xml_documents(spark, str(tmp_path)), ["abs"])
    assert {(r.period, r.text) for r in texts.collect()} == {("2001", "A <b Abs C1 C2 D")}
    assert attributes.first().referential_documents[0] == "US001"
    with pytest.raises(ValueError):
        writers.attributes(attributes, str(tmp_path / "out"))
    writers.json_rows(records.filter("error IS NULL").drop("error", "skipped"), str(tmp_path / "lines"))
    lines = spark.read.text(str(tmp_path / "lines")).unionByName(spark.createDataFrame([("{bad",)], "value string"))
    assert readers.json_lines(lines).filter("corrupt IS NOT NULL").count() == 1


def test_files(spark, tmp_path):
    for sub, name, text in (("2301", "a v1.txt", "x\ny"), ("2301", "b.txt", "y"), ("2302", "c.txt", "z")):
        (tmp_path / "t" / sub).mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / sub / name).write_text(text)
    paths = readers.partition_paths([str(tmp_path / "t")], [2023], [1, 2])
    texts = readers.text_files(spark, paths)
    assert sorted(r.paper_id for r in texts.collect()) in (["a v1.txt", "b.txt", "c.txt"], ["a%20v1.txt", "b.txt", "c.txt"])
    assert readers.text_files(spark, paths, texts.filter("text = 'z'")).count() == 2
    (tmp_path / "o.csv").write_text('text,triplets,paper_id\n"a\nb","(a; ""b""; c)",p1\nx,,p2\n')
    assert [tuple(r) for r in readers.answers(spark, str(tmp_path / "o.csv")).collect()] == [("a\nb", '(a; "b"; c)', "p1")]
    (tmp_path / "m.json").write_text(json.dumps({"id": "1", "categories": "a b", "x": 1}) + "\n")
    assert selection.category_rows(readers.metadata(spark, str(tmp_path / "m.json"))).first().categories == ["a", "b"]
    (tmp_path / "f.json").write_text(json.dumps({"with cache": {"32": 0.5, "64": 1.0}}))
    assert sorted(tuple(r) for r in readers.footprints(spark, str(tmp_path / "f.json")).collect()) == [("with cache", 32.0, 0.5), ("with cache", 64.0, 1.0)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.pdf").write_bytes(b"%PDF")
    assert readers.pdf_files(spark, str(tmp_path / "p")).first().file_name == "x.pdf"
    assert readers.pdf_texts(spark, str(tmp_path / "p"), lambda b, n: b.decode() + str(n), 2).first().text == "%PDF2"
    assert readers.pdf_texts(spark, str(tmp_path / "p"), lambda b, n: 1 / 0).first().text == ""
    assert spark.createDataFrame([("a &amp; b",)], "t string").select(readers.unescaped(F.col("t")).alias("t")).first().t == "a & b"
    dump = writers.triple_dump(triples(spark, [("a", "b", "c")])).first().text
    assert dump == "p\n('a', 'b', 'c')---\n" + "-" * 60


def test_incremental_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("one")
    go = lambda: incremental.run_available(incremental.new_texts(spark, str(tmp_path / "in")), lambda d: d.filter("text <> ''"), str(tmp_path / "out"), str(tmp_path / "cp"))
    go()
    (tmp_path / "in" / "2.txt").write_text("two")
    go()
    go()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one", "two"]


def test_whole_way(spark, sf):
    from triplewright.plans import views

    papers = views.papers(spark, sf)
    loaded = pipelines.loaded(papers, Loading(filter_by_version=True, filter_categories=True, categories=("en",)))
    assert 0 < loaded.count() <= papers.count() // 2
    assert pipelines.normalised(loaded).count() == loaded.count()
    assert pipelines.papers_to_triples(papers).count() > 0


def test_keywords(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, None)], "doc_id bigint, text string")
    out = keyterms.keywords(df).collect()
    assert {r.doc_id for r in out} == {1} and len(out) == 5 and out[0].score == pytest.approx(1.0)
    assert keyterms.keyword_counts(keyterms.keywords(df)).count() == 5


def test_numbers_of_triples_run_through_a_papers_answers(spark):
    rows = [("p", 2, "(g; h; i) x (j; k; l)"), ("p", 0, "(a; b; c)\n(d; e; f)"), ("p", 1, "none"), ("p", 3, None), ("q", 5, "(m; n; o)"), (None, 0, "(r; s; t)")]
    found = T.parsed(spark.createDataFrame(rows, "paper_id string, chunk_no int, triplets string"))
    assert dict(found.dtypes)["pos"] == "int"
    assert {(r.paper_id, r.pos, r.subject) for r in found.collect()} == {("p", 0, "a"), ("p", 1, "d"), ("p", 2, "g"), ("p", 3, "j"), ("q", 0, "m"), (None, 0, "r")}


def test_answers_without_numbers_are_taken_in_the_order_of_their_text(spark):
    rows = [("p", "(c; d; e)"), ("p", "(a; b; c)(d; e; f)"), ("p", "(a; b; c)(d; e; f)")]
    found = T.parsed(spark.createDataFrame(rows, "paper_id string, triplets string")).orderBy("pos").collect()
    assert [(r.pos, r.subject) for r in found] == [(0, "a"), (1, "d"), (2, "a"), (3, "d"), (4, "c")]
    assert T.parsed(spark.createDataFrame([], "paper_id string, triplets string")).count() == 0
