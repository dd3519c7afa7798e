"""Queries over the synthetic tables, one or more for each operator, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FILLER_VERBS, Cleaning, Filtering
from .functions import abbreviations, batching
from .functions import patents as PF
from .functions import text as X
from .operators import inference, keyterms, memory, patents, selection, vocabulary
from .operators import triples as T
from .plans import pipelines, views
from .staging import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Thresholds that leave words on both sides of each cut on the small tables.
LEAST_FREQUENCY, LEAST_PAPERS, IN_PAPER, IN_BOOK, CUTOFF, PERCENTILE = 3, 2, 2, 2, 0.1, 0.85
STOPWORDS = ["the", "and", "of", "to", "in", "is", "a", "for", "on", "with", "that", "it", "was", "as", "by"]
TERMS = ["anthe", "of the", "Étion", "und", "queta"]
CHAT = [{"role": "user", "content": "The first text is: \n A is B."}, {"role": "assistant", "content": "[(A; is; B)]"}]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _tokens(c: str) -> str:
    return views.TOKENS.format(c)


PARSED = f"""{views.ANSWERS_SQL},
found AS (SELECT paper_id, chunk_no, unnest(m) AS m, generate_subscripts(m, 1) AS k FROM (SELECT paper_id, chunk_no, regexp_extract_all(triplets, '\\(.+?;.+?;.+?\\)') AS m FROM answers) WHERE len(m) > 0),
parsed AS (SELECT paper_id, (row_number() OVER (PARTITION BY paper_id ORDER BY chunk_no, k) - 1)::INTEGER AS pos, regexp_extract(m, '\\((.+);(.+);(.+)\\)', 1) AS subject, regexp_extract(m, '\\((.+);(.+);(.+)\\)', 2) AS predicate, regexp_extract(m, '\\((.+);(.+);(.+)\\)', 3) AS object FROM found)"""
_plain = "regexp_replace(lower({0}), '[^a-zA-Z0-9 -]', '', 'g')"
_long = "array_to_string(list_filter({0}, lambda w: length(w) > 3), ' ')"
_once = "array_to_string(list_filter({0}, lambda w, i: i = 1 OR w <> ({0})[i - 1]), ' ')"
CLEANED = f"""{PARSED},
c1 AS (SELECT paper_id, pos, {_plain.format('subject')} AS s, {_plain.format('predicate')} AS p, {_plain.format('object')} AS o FROM parsed),
c2 AS (SELECT paper_id, pos, array_to_string(list_filter({_tokens('s')}, lambda w: NOT list_contains({_list(STOPWORDS)}, w)), ' ') AS s,
    CASE WHEN len({_tokens('p')}) > 1 THEN array_to_string(list_filter({_tokens('p')}, lambda w: length(w) > 1 AND NOT list_contains({_list(FILLER_VERBS)}, w)), ' ') ELSE p END AS p,
    array_to_string(list_filter({_tokens('o')}, lambda w: NOT list_contains({_list(STOPWORDS)}, w)), ' ') AS o FROM c1),
c3 AS (SELECT paper_id, pos, {_long.format(_tokens('s'))} AS s, p, {_long.format(_tokens('o'))} AS o FROM c2 WHERE s <> '' AND o <> ''),
c4 AS (SELECT paper_id, pos, {_once.format(_tokens('s'))} AS subject, p AS predicate, {_once.format(_tokens('o'))} AS object FROM c3 WHERE s <> '' AND o <> ''),
judged AS (SELECT *, len({_tokens('subject')}) <= 6 AND len({_tokens('predicate')}) <= 6 AND len({_tokens('object')}) <= 6 AS kept FROM c4),
cleaned AS (SELECT * EXCLUDE (kept) FROM judged WHERE kept)"""
WORDS = f"""{CLEANED},
occurrences AS (SELECT unnest(list_concat({_tokens('subject')}, {_tokens('object')})) AS word FROM cleaned),
frequency AS (SELECT word, count(*) AS n FROM occurrences GROUP BY word)"""
COUNTS = f"""
counts AS (SELECT category, term, count(*) AS n_papers FROM (
    SELECT category, doc_id, term, count(*) AS k FROM (SELECT source AS category, doc_id, unnest({_tokens('lower(text)')}) AS term FROM documents) GROUP BY ALL) WHERE k >= {IN_PAPER} GROUP BY ALL),
files AS (SELECT source AS category, count(*) AS n_files FROM documents GROUP BY source)"""
BOOKS = f"""
in_books AS (SELECT word, count(*) AS n FROM (SELECT item_id, word, count(*) AS k FROM (SELECT item_id, unnest({_tokens('lower(text)')}) AS word FROM benchmark) GROUP BY ALL) WHERE k >= {IN_BOOK} GROUP BY word)"""
SCORES = f"""{COUNTS}, {BOOKS},
in_papers AS (SELECT term, sum(n_papers)::BIGINT AS n FROM counts GROUP BY term),
scores AS (SELECT coalesce(b.word, p.term) AS term,
    CASE WHEN coalesce(p.n, 0) < {LEAST_PAPERS} THEN '-infinity'::DOUBLE WHEN b.n IS NULL THEN 'infinity'::DOUBLE
         ELSE -ln(b.n / (SELECT count(*) FROM benchmark)::DOUBLE) + ln(p.n / (SELECT count(*) FROM documents)::DOUBLE) END AS score
  FROM in_books b FULL JOIN in_papers p ON b.word = p.term
  WHERE NOT regexp_matches(coalesce(b.word, p.term), '[!-/:-@\\[-`{{-~]') AND NOT regexp_matches(coalesce(b.word, p.term), '^\\d+$') AND length(coalesce(b.word, p.term)) >= 2)"""
ENTROPY = f"""
rates AS (SELECT term, n_papers, n_papers::DOUBLE / n_files AS r FROM counts JOIN files USING (category)),
entropy AS (SELECT term, ln(sum(r)) - sum(r * ln(r)) / sum(r) AS entropy FROM rates GROUP BY term HAVING sum(n_papers) >= {LEAST_PAPERS})"""
REMOVAL = f"""{WORDS}, {SCORES}, {ENTROPY},
low AS (SELECT word FROM (SELECT word, row_number() OVER (ORDER BY coalesce(round(score, 9), 'infinity'::DOUBLE), word) AS r, count(*) OVER () AS n FROM frequency LEFT JOIN scores ON word = term) WHERE r <= floor({CUTOFF} * n)),
high AS (SELECT word FROM frequency JOIN entropy ON word = term WHERE round(entropy, 9) > (SELECT quantile_cont(round(entropy, 9), {PERCENTILE}) FROM entropy)),
removal AS (SELECT word FROM frequency WHERE n < {LEAST_FREQUENCY} UNION SELECT word FROM low UNION SELECT word FROM high)"""
SPLIT = f"""{REMOVAL},
parts AS (SELECT paper_id, pos, 1 AS part, unnest({_tokens('subject')}) AS word FROM cleaned UNION ALL SELECT paper_id, pos, 2, unnest({_tokens('object')}) FROM cleaned),
spared AS (SELECT paper_id, pos FROM parts ANTI JOIN removal USING (word) GROUP BY paper_id, pos HAVING count(DISTINCT part) = 2),
split AS (SELECT c.*, s.pos IS NOT NULL AS kept FROM cleaned c LEFT JOIN spared s USING (paper_id, pos))"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.parsed(views.answers(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.judged(_parsed(spark, sf_dir), Cleaning(stopwords=tuple(STOPWORDS)))


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cleaned(_parsed(spark, sf_dir), Cleaning(stopwords=tuple(STOPWORDS)))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.category_counts(views.labelled_papers(spark, sf_dir), IN_PAPER)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.labelled_papers(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n_files"))


def _in_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.document_frequency(views.books(spark, sf_dir), IN_BOOK)


def _scores(spark: SparkSession, sf_dir: str, counts: DataFrame | None = None) -> DataFrame:
    counts = _counts(spark, sf_dir) if counts is None else counts
    n_books, n_papers = (d.agg(F.count(F.lit(1))).scalar() for d in (views.books(spark, sf_dir), views.read(spark, sf_dir, "documents")))
    return vocabulary.term_scores(_in_books(spark, sf_dir), vocabulary.pooled(counts), n_books, n_papers, LEAST_PAPERS).withColumn("score", F.round("score", 9))


def _entropy(spark: SparkSession, sf_dir: str, counts: DataFrame | None = None) -> DataFrame:
    return vocabulary.entropies(_counts(spark, sf_dir) if counts is None else counts, _files(spark, sf_dir), LEAST_PAPERS).withColumn("entropy", F.round("entropy", 9))


def _low(spark: SparkSession, sf_dir: str, cleaned: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    return vocabulary.lowest_words(vocabulary.vocabulary(cleaned), _scores(spark, sf_dir, counts), CUTOFF)


def _high(spark: SparkSession, sf_dir: str, cleaned: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    return vocabulary.high_entropy_words(vocabulary.vocabulary(cleaned), _entropy(spark, sf_dir, counts), PERCENTILE)


def _removal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The cleaned triples and the words to remove; triples and word counts, which several lists read, are made once."""
    cleaned, counts = stage(_cleaned(spark, sf_dir), "cleaned"), stage(_counts(spark, sf_dir), "counts")
    return cleaned, vocabulary.union(vocabulary.rare_words(cleaned, LEAST_FREQUENCY), _low(spark, sf_dir, cleaned, counts), _high(spark, sf_dir, cleaned, counts))


@query(f"WITH {PARSED} SELECT * FROM parsed")
def triple_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir)


@query(f"WITH {CLEANED} SELECT * FROM cleaned")
def triple_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir)


@query(f"WITH {WORDS} SELECT word, n FROM frequency")
def triple_word_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.frequency(_cleaned(spark, sf_dir))


@query(f"WITH {CLEANED} SELECT paper_id, count_if(kept)::BIGINT AS n, coalesce(string_agg(subject || '|' || predicate || '|' || object, '/' ORDER BY pos) FILTER (kept), '') AS listed FROM judged GROUP BY paper_id")
def triple_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t: F.concat_ws("|", t["subject"], t["predicate"], t["object"])
    return T.nested(_judged(spark, sf_dir)).select("paper_id", F.size("triplets").cast("bigint").alias("n"), F.array_join(F.transform("triplets", one), "/").alias("listed"))


@query(f"WITH {CLEANED} SELECT count(DISTINCT paper_id) AS n_papers, count_if(kept)::BIGINT AS n_triples, count_if(kept)::DOUBLE / count(DISTINCT paper_id) AS triples_a_paper FROM judged")
def triple_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.summary(_judged(spark, sf_dir))


@query(f"WITH {CLEANED} SELECT subject AS source, predicate, object AS target, count(*) AS n FROM cleaned GROUP BY ALL")
def triple_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.graph(_cleaned(spark, sf_dir))[1]


@query(f"WITH {CLEANED} SELECT term, count(*) AS degree FROM (SELECT unnest([subject, object]) AS term FROM cleaned) GROUP BY term")
def triple_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.graph(_cleaned(spark, sf_dir))[0]


@query(f"WITH {WORDS} SELECT word FROM frequency WHERE n < {LEAST_FREQUENCY}")
def vocab_low_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.rare_words(_cleaned(spark, sf_dir), LEAST_FREQUENCY)


@query(f"WITH {WORDS}, {BOOKS} SELECT f.word FROM frequency f LEFT JOIN in_books b USING (word) WHERE coalesce(b.n, 0) < 2")
def vocab_low_freq_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.rare_words(_cleaned(spark, sf_dir), 2, _in_books(spark, sf_dir))


@query(f"WITH {BOOKS} SELECT word, n FROM in_books")
def book_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_books(spark, sf_dir)


@query(f"WITH {COUNTS} SELECT category, term, n_papers FROM counts")
def category_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@query(f"WITH {COUNTS} SELECT term, sum(n_papers)::BIGINT AS n FROM counts GROUP BY term")
def pooled_paper_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.pooled(_counts(spark, sf_dir))


@query("SELECT count(*) AS n_files FROM documents")
def total_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.total_files(_files(spark, sf_dir))


_kind = "CASE WHEN score = '{0}infinity'::DOUBLE THEN '{1}'"


@query(f"WITH {SCORES} SELECT term, {_kind.format('', 'high')} WHEN score = '-infinity'::DOUBLE THEN 'low' ELSE 'finite' END AS kind, CASE WHEN isinf(score) THEN 0.0::DOUBLE ELSE round(score, 9) END AS score FROM scores")
def term_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, low = F.col("score") == float("inf"), F.col("score") == float("-inf")
    kind = F.when(high, "high").when(low, "low").otherwise("finite")
    return _scores(spark, sf_dir).select("term", kind.alias("kind"), F.when(high | low, F.lit(0.0)).otherwise(F.col("score")).alias("score"))


@query(f"WITH {REMOVAL} SELECT word FROM low")
def bookcorpus_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _low(spark, sf_dir, _cleaned(spark, sf_dir))


@query(f"WITH {COUNTS}, {ENTROPY} SELECT term, abs(round(entropy, 6)) AS entropy FROM entropy")
def entropy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entropy(spark, sf_dir).withColumn("entropy", F.abs(F.round("entropy", 6)))  # no negative zero


@query(f"WITH {REMOVAL} SELECT word FROM high")
def entropy_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _high(spark, sf_dir, _cleaned(spark, sf_dir))


@query(f"WITH {WORDS}, {COUNTS}, {ENTROPY} SELECT count_if(term IS NULL)::BIGINT AS n_missing, count_if(term IS NULL)::DOUBLE / count(*) AS share FROM frequency LEFT JOIN entropy ON word = term")
def entropy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.uncovered_share(vocabulary.vocabulary(_cleaned(spark, sf_dir)), _entropy(spark, sf_dir))


@query(f"WITH {REMOVAL} SELECT word FROM removal")
def vocab_removed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removal(spark, sf_dir)[1]


@query(f"WITH {SPLIT} SELECT paper_id, pos, subject, predicate, object FROM split WHERE kept")
def triples_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.kept_triples(*_removal(spark, sf_dir))


@query(f"WITH {SPLIT} SELECT paper_id, pos, subject, predicate, object FROM split WHERE NOT kept")
def triples_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.removed_triples(*_removal(spark, sf_dir))


_base = "regexp_replace(regexp_replace(file_name, '\\.[A-Za-z]+$', ''), 'v\\d+$', '')"
_version = "regexp_extract(file_name, 'v(\\d+)\\.[A-Za-z]+$', 1)::INTEGER"


@query(f"WITH {views.PAPERS_SQL} SELECT doc_id, file_name FROM (SELECT *, row_number() OVER (PARTITION BY {_base} ORDER BY {_version} DESC, file_name) AS r FROM papers) WHERE r = 1")
def newest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.newest_versions(views.papers(spark, sf_dir)).select("doc_id", "file_name")


@query(f"WITH {views.PAPERS_SQL} SELECT {_base} AS base, max({_version}) AS version FROM papers GROUP BY 1")
def max_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.max_versions(views.papers(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE source = 'src1' OR lang = 'fr'")
def category_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.in_categories(views.papers(spark, sf_dir), ["src1", "fr"]).select("doc_id")


@query("SELECT doc_id FROM documents WHERE NOT (source = 'src1' OR lang = 'fr')")
def category_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.in_categories(views.papers(spark, sf_dir), ["src1", "fr"], inverse=True).select("doc_id")


@query("SELECT doc_id FROM documents WHERE (doc_id // 2) NOT IN (SELECT doc_id // 2 FROM labels)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = views.papers(spark, sf_dir)
    done = papers.join(views.read(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return selection.not_done(papers, done).select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id DESC) AS r FROM documents WHERE (doc_id // 2) NOT IN (SELECT doc_id // 2 FROM labels WHERE toxic = 1) AND (doc_id // 2) IN (SELECT doc_id // 2 FROM documents WHERE lang = 'en')) WHERE r = 1")
def combined_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = views.papers(spark, sf_dir)
    done = papers.join(views.read(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_semi")
    kept = selection.in_categories(papers, ["en"]).select(X.base_id(F.col("file_name")).alias("id"))
    return selection.listing(papers, done, kept, newest_only=True).select("doc_id")


_a, _i = "(strpos(lower(raw_text), 'abstract') - 1)", "(strpos(lower(raw_text), 'introduction') - 1)"
_start = f"CASE WHEN {_a} >= 0 AND {_i} >= 0 THEN least({_a}, {_i}) WHEN {_a} < 0 AND {_i} < 0 THEN 100 ELSE greatest({_a}, {_i}) END"
ABSTRACT = f"abstracts AS (SELECT doc_id, substring(raw_text, ({_start} + 1)::INTEGER, (CASE WHEN {_a} >= 0 AND {_a} < {_i} THEN greatest({_i} - {_a}, 1250) ELSE 1250 END)::INTEGER) AS abstract FROM papers)"


@query(f"WITH {views.PAPERS_SQL}, {ABSTRACT} SELECT doc_id, abstract FROM abstracts")
def abstract_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.papers(spark, sf_dir).select("doc_id", X.abstract(F.col("raw_text")).alias("abstract"))


_any = " OR ".join(f"contains(lower(abstract), lower('{t}'))" for t in TERMS)


@query(f"WITH {views.PAPERS_SQL}, {ABSTRACT} SELECT doc_id FROM abstracts WHERE {_any}")
def abstract_term_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.with_terms(views.papers(spark, sf_dir), TERMS, "raw_text").select("doc_id")


_case = ABSTRACT.replace("lower(raw_text)", "raw_text").replace("'abstract'", "'abstract'").replace("1250", "2000")
_any_case = " OR ".join(f"contains(abstract, '{t}')" for t in TERMS)


@query(f"WITH {views.PAPERS_SQL}, {_case} SELECT doc_id FROM abstracts WHERE {_any_case}")
def key_term_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyterms.with_key_term(views.papers(spark, sf_dir), TERMS, "raw_text").select("doc_id")


_r = "(CASE WHEN strpos(reverse(lower(raw_text)), reverse('{0}')) = 0 THEN -1 ELSE length(raw_text) - strpos(reverse(lower(raw_text)), reverse('{0}')) - length('{0}') + 1 END)"
_ref, _ack = _r.format("reference"), _r.format("acknowledgement")
BODY = f"""bounds AS (SELECT doc_id, raw_text, CASE WHEN {_a} >= 0 AND {_i} >= 0 THEN least({_a}, {_i}) WHEN greatest({_a}, {_i}) < 0 THEN 100 ELSE greatest({_a}, {_i}) END AS first,
    CASE WHEN {_ack} >= 0 AND {_ack} < {_ref} AND {_ack} > length(raw_text) / 2 THEN {_ack} ELSE {_ref} END AS last FROM papers),
bodies AS (SELECT doc_id, substring(raw_text, (first + 1)::INTEGER, greatest((CASE WHEN last < 0 THEN length(raw_text) ELSE last END) - first, 0)::INTEGER) AS body FROM bounds)"""


@query(f"WITH {views.PAPERS_SQL}, {BODY} SELECT doc_id, body FROM bodies")
def strip_header_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.papers(spark, sf_dir).select("doc_id", X.body(F.col("raw_text")).alias("body"))


@query(f"WITH {views.PAPERS_SQL} SELECT doc_id, regexp_replace(raw_text, '([\\p{{L}}\\p{{N}}_])-\\s+([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g') AS line FROM papers")
def line_break_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.papers(spark, sf_dir).select("doc_id", X.mend_line_breaks(F.col("raw_text")).alias("line"))


@query(f"WITH {views.PAPERS_SQL} SELECT doc_id, regexp_replace(raw_text, '{X.CITATION.replace(chr(39), chr(39) * 2)}', '', 'g') AS line FROM papers")
def citation_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.papers(spark, sf_dir).select("doc_id", X.strip_citations(F.col("raw_text")).alias("line"))


SENTENCES = f"""{views.PAPERS_SQL}, {BODY},
marked AS (SELECT doc_id, list_filter(string_split(regexp_replace(replace(body, chr(10), ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS s FROM bodies)"""


@query(f"WITH {SENTENCES} SELECT doc_id, unnest(s) AS sentence, (generate_subscripts(s, 1) - 1)::INTEGER AS pos FROM marked")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.papers(spark, sf_dir).select("doc_id", F.posexplode(X.sentences(X.body(F.col("raw_text")))).alias("pos", "sentence"))


_mark = "CASE WHEN generate_subscripts(l, 1) % 7 IN (2, 3) THEN unnest(l) || ' et al.' ELSE unnest(l) END"


@query(
    f"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
r AS (SELECT doc_id, generate_subscripts(l, 1) AS i, {_mark} AS s FROM t),
g AS (SELECT *, coalesce(lag(ends_with(s, 'et al.')) OVER (PARTITION BY doc_id ORDER BY i), false) AS goes FROM r),
h AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g)
SELECT doc_id, (k - 1)::INTEGER AS pos, string_agg(s, ' ' ORDER BY i) AS sentence FROM h GROUP BY doc_id, k"""
)
def et_al_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.when(((i + 1) % 7).isin(2, 3), F.concat(s, F.lit(" et al."))).otherwise(s))
    return views.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.joined_et_al(lines)).alias("pos", "sentence"))


@query(
    """WITH t AS (SELECT doc_id::VARCHAR AS paper_id, string_split(text, chr(10)) AS l FROM documents),
r AS (SELECT paper_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS s FROM t)
SELECT paper_id, (i // 15)::INTEGER AS chunk_no, string_agg(s, ' ' ORDER BY i) AS text FROM r GROUP BY paper_id, i // 15"""
)
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = views.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.split("text", "\n").alias("sentences"))
    return inference.line_chunks(texts, 15)


@query("SELECT event_id, period FROM (SELECT event_id, strftime(ts, '%y%m') AS period, row_number() OVER (PARTITION BY strftime(ts, '%y%m') ORDER BY event_id) AS r FROM events) WHERE r <= 50")
def period_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyMM").alias("period"))
    return selection.first_of_each_period(events, 50, order="event_id")


@query(f"SELECT w AS keyword, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest({_tokens('lower(text)')}) AS w FROM documents) GROUP BY w")
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = views.read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(X.tokens(F.lower("text")))).alias("keyword"))
    return keyterms.keyword_counts(words)


@query("SELECT count(*) AS n, count_if(coalesce(text, '') = '')::BIGINT AS n_empty, 100.0::DOUBLE * count_if(coalesce(text, '') = '') / count(*) AS percent_empty FROM documents")
def empty_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.empty_share(views.read(spark, sf_dir, "documents"))


_points = "SELECT label::VARCHAR AS curve, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings"


@query(f"SELECT curve, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM ({_points}) GROUP BY curve")
def memory_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("curve"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return memory.fits(points).select("curve", *(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")))


@query("SELECT l_orderkey, l_linenumber, greatest(floor(40.0 / ((CASE WHEN l_quantity < 5 THEN 1 WHEN l_quantity < 10 THEN 2 WHEN l_quantity < 20 THEN 3 ELSE 4 END) * ceil((l_partkey + 400) / 2048.0))), 1)::BIGINT AS batch FROM lineitem")
def batch_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = batching.heuristic_batch(F.col("l_quantity"), F.lit(40.0), F.col("l_partkey"), F.lit(400))
    return views.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", batch.cast("bigint").alias("batch"))


_code = "regexp_extract(code, '^([A-Z])([0-9]{{2}})([A-Z])\\s?([0-9]{{1,4}})\\s?/\\s?([0-9]{{2,6}})', {0})".replace("{{", "{").replace("}}", "}")
_c = [_code.replace("{0}", str(k)) for k in range(1, 6)]


@query(f"WITH {views.PATENTS_SQL} SELECT publication_number, {_c[0]} AS section, {_c[0]} || {_c[1]} AS section_class, {_c[0]} || {_c[1]} || {_c[2]} AS section_class_subclass, {_c[0]} || {_c[1]} || {_c[2]} || ' ' || {_c[3]} || '/' || {_c[4]} AS section_class_subclass_group FROM patents")
def ipc_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.patent_rows(spark, sf_dir).select("publication_number", PF.parsed_code(F.col("code")).alias("c")).select("publication_number", "c.*")


_text = "publication_title || ' ' || array_to_string(abstract, ' ') || ' ' || array_to_string(claims, ' ')"
_keys = " OR ".join(f"contains(lower({_text}), lower('{t}'))" for t in TERMS)


@query(f"WITH {views.PATENTS_SQL} SELECT publication_number FROM patents WHERE {_keys}")
def patent_keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patents.with_keywords(views.patent_rows(spark, sf_dir), TERMS).select("publication_number")


@query(f"WITH {views.PATENTS_SQL} SELECT publication_number, {_text} || ' ' || array_to_string(descriptions, chr(10)) AS text FROM patents")
def patent_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.patent_rows(spark, sf_dir)
    return p.select("publication_number", PF.full_text(*map(F.col, ("publication_title", "abstract", "claims", "descriptions"))).alias("text"))


_q = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_turns = "".join(("GPT4 Correct User: " if m["role"] == "user" else "GPT4 Correct Assistant: ") + m["content"] + "<|end_of_turn|>" for m in CHAT)


@query(f"SELECT conv_id, turn, {_q(_turns + 'GPT4 Correct User: ' + batching.NEXT)} || text || '<|end_of_turn|>GPT4 Correct Assistant:' AS prompt FROM conversations")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "conversations").select("conv_id", "turn", batching.role_prompt(F.col("text"), CHAT).alias("prompt"))


@query("SELECT conv_id, turn, regexp_extract(role || 'assistant' || text, '(?s)^.*assistant(.*)$', 1) AS answer FROM conversations")
def answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = F.concat("role", F.lit("assistant"), "text")
    return views.read(spark, sf_dir, "conversations").select("conv_id", "turn", batching.answer(output, "meta-llama/Meta-Llama-3-8B-Instruct").alias("answer"))


@query("SELECT count_if(length(text) > 200)::BIGINT AS n_over FROM conversations")
def over_length_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "conversations").agg(batching.over_length(F.col("text"), 200).alias("n_over"))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || ':42'), doc_id LIMIT 100")
def sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: its size is what it is asked for."""
    return selection.sample(views.read(spark, sf_dir, "documents"), 100, "doc_id").select("doc_id")


@query("SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY md5(item_id || ':7'), item_id) AS r, count(*) OVER () AS n FROM benchmark) WHERE r <= floor(0.3 * n)")
def book_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: a share of the books."""
    return selection.sample(views.read(spark, sf_dir, "benchmark"), 0.3, "item_id", seed=7).select("item_id")


_name = lambda a, b, sep: f"trim(concat_ws('{sep}', nullif(nullif({a}, 'unknown'), ''), nullif(nullif({b}, 'unknown'), '')))"


@query(f"SELECT c_custkey, {_name('c_name', 'c_mktsegment', ' ')} AS name FROM customer")
def party_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "customer").select("c_custkey", X.name_of(F.col("c_name"), F.col("c_mktsegment")).alias("name"))


@query("SELECT doc_id, repeat('-', least(3, length(t))) || repeat('*', greatest(least(7, length(t)) - 3, 0)) || repeat('-', greatest(length(t) - 7, 0)) AS mask FROM (SELECT doc_id, text AS t FROM documents)")
def change_log_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "documents").select("doc_id", X.change_mask(F.col("text"), F.array(F.lit(3)), F.array(F.lit(7))).alias("mask"))


@query()
def abbrev_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.concat(F.split(F.concat(F.lit("Deep Neural Network (DNN) models. "), "text"), "\n"), F.array(F.lit("A DNN and dnn, not DNNs.")))
    return views.read(spark, sf_dir, "documents").select("doc_id", abbreviations.expanded(lines).alias("lines"))


_lemma = "array_to_string(list_transform({0}, lambda w: CASE WHEN ends_with(w, 's') AND length(w) > 3 THEN substring(w, 1, (length(w) - 1)::INTEGER) ELSE w END), ' ')"


@query(f"WITH {PARSED} SELECT paper_id, pos, {', '.join(_lemma.format(_tokens(c)) + ' AS ' + c for c in ('subject', 'predicate', 'object'))} FROM parsed")
def lemma_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lemmatised(T.parsed(views.answers(spark, sf_dir)), lambda x: " ".join(w[:-1] if w.endswith("s") and len(w) > 3 else w for w in x.split()))


@query(
    f"""WITH t AS (SELECT doc_id::VARCHAR AS paper_id, string_split(text, chr(10)) AS l FROM documents),
r AS (SELECT paper_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS s FROM t),
c AS (SELECT paper_id, (i // 15)::INTEGER AS chunk_no, string_agg(s, ' ' ORDER BY i) AS text FROM r GROUP BY paper_id, i // 15),
w AS (SELECT *, {_tokens('text')} AS w FROM c)
SELECT paper_id, chunk_no, text, CASE WHEN len(w) > 2 THEN '(' || w[1] || '; ' || w[2] || '; ' || w[3] || ')' ELSE '' END AS triplets FROM w"""
)
def llm_extract_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = views.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.split("text", "\n").alias("sentences"))
    return inference.extract(texts)


@query()
def key_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyterms.keywords(views.read(spark, sf_dir, "benchmark"), key="item_id")


@query()
def papers_to_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.papers_to_triples(views.papers(spark, sf_dir))


@query(f"WITH {SPLIT} SELECT paper_id, pos, kept FROM split")
def filtered_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both results of the whole vocabulary filter, over all books."""
    settings = Filtering(
        min_num_appearances_for_frequency=LEAST_FREQUENCY,
        min_num_counts_term_in_single_book=IN_BOOK,
        min_num_counts_term_in_single_paper=IN_PAPER,
        min_num_paper_appearances_term_bookcorpus_scores=LEAST_PAPERS,
        min_num_paper_appearances_term=LEAST_PAPERS,
        cutoff_bookcorpus=CUTOFF,
        entropy_percentile_threshold=PERCENTILE,
        use_entropy=True,
        max_length_book=None,
        subset_book_corpus=None,
    )
    kept, removed = pipelines.filtered(stage(_cleaned(spark, sf_dir), "cleaned"), views.books(spark, sf_dir), views.labelled_papers(spark, sf_dir), settings)
    return kept.withColumn("kept", F.lit(True)).unionByName(removed.withColumn("kept", F.lit(False))).select("paper_id", "pos", "kept")


@query()
def papers_to_final_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = stage(pipelines.papers_to_triples(views.papers(spark, sf_dir)), "cleaned")
    settings = Filtering(min_num_appearances_for_frequency=LEAST_FREQUENCY, min_num_counts_term_in_single_book=IN_BOOK, min_num_counts_term_in_single_paper=IN_PAPER, subset_book_corpus=None)
    return pipelines.filtered(cleaned, views.books(spark, sf_dir), views.labelled_papers(spark, sf_dir), settings)[0]


from . import queries_io  # noqa: E402, F401
