"""Queries over sources, sinks, patents, models and selections, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DISTANCES, Cleaning, Loading
from .functions import batching
from .functions import text as X
from .operators import memory, patents, selection, vocabulary
from .operators import triples as T
from .plans import pipelines, views
from .queries import BODY, CLEANED, LEAST_FREQUENCY, STOPWORDS, WORDS, _cleaned, _parsed, _tokens, query
from .sources import readers, writers
from .staging import new_path


@query(f"WITH {views.ANSWERS_SQL} SELECT paper_id, count(*) AS n_rows, string_agg(triplets, chr(10) ORDER BY chunk_no) AS triplets FROM answers WHERE triplets <> '' GROUP BY paper_id")
def answer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written as CSV files, appended to, and read again in their order."""
    path = new_path(spark, "answers")
    rows = views.answers(spark, sf_dir).filter("triplets <> ''").repartition(4, "paper_id").sortWithinPartitions("paper_id", "chunk_no")
    rows.select(F.lit("a \"b\"\nc").alias("text"), "triplets", "paper_id").write.option("header", True).option("escape", '"').csv(path)
    rows.select(F.lit("x").alias("text"), F.lit(None).cast("string").alias("triplets"), "paper_id").limit(9).write.mode("append").option("header", True).csv(path)
    found = readers.answers(spark, path, numbered=True).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "triplets"))).alias("l"))
    return found.select("paper_id", F.size("l").cast("bigint").alias("n_rows"), F.array_join(F.transform("l", lambda x: x["triplets"]), "\n").alias("triplets"))


@query("SELECT item_id, text || chr(10) AS text FROM benchmark WHERE item_id % 3 <> 0")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file a benchmark item; a third of them is done already."""
    path = new_path(spark, "texts")
    items = views.read(spark, sf_dir, "benchmark").repartition(8, "item_id")
    items.write.partitionBy("item_id").text(path)
    item = lambda c: F.regexp_extract(c, r"item_id=(\d+)", 1).cast("bigint")
    seen = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("paper_id"), item(F.col("_metadata.file_path")).alias("item_id"))
    left = selection.missing(seen, seen.filter("item_id % 3 = 0"), "item_id")
    ids = spark.read.text(path, wholetext=True).select(item(F.col("_metadata.file_path")).alias("item_id"), F.col("value").alias("text"))
    return ids.join(left, "item_id", "left_semi").select("item_id", "text")


@query("SELECT CASE WHEN doc_id % 20 = 3 THEN NULL ELSE doc_id::VARCHAR END AS publication_number, CASE WHEN doc_id % 20 = 3 THEN NULL ELSE text END AS publication_title, CASE WHEN doc_id % 20 = 3 THEN '{bad ' || doc_id END AS corrupt FROM documents")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, some of which can't be parsed and stay as they are."""
    good = F.to_json(F.struct(F.col("doc_id").cast("string").alias("publication_number"), F.col("text").alias("publication_title")))
    lines = views.read(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 20 == 3, F.concat(F.lit("{bad "), "doc_id")).otherwise(good).alias("value"))
    return readers.json_lines(lines).select("publication_number", "publication_title", "corrupt")


@query("SELECT 'curve ' || n_regionkey AS curve, n_nationkey::DOUBLE AS x, n_nationkey * 0.5::DOUBLE AS y FROM nation")
def footprint_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "footprints")
    points = views.read(spark, sf_dir, "nation").groupBy(F.concat(F.lit("curve "), "n_regionkey").alias("curve"))
    points = points.agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.col("n_nationkey") * 0.5))).alias("m"))
    points.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("curve", "m")))).alias("value")).write.text(path)
    return readers.footprints(spark, path)


@query(f"WITH {WORDS} SELECT word FROM frequency WHERE n < {LEAST_FREQUENCY}")
def removed_word_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal lists written as text and read again."""
    path = new_path(spark, "words")
    writers.words(vocabulary.rare_words(_cleaned(spark, sf_dir), LEAST_FREQUENCY), path)
    return spark.read.text(path).select(F.trim("value").alias("word"))


@query("SELECT strftime(ts, '%y%m') AS period, count(*) AS n FROM events GROUP BY 1")
def period_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written to a folder a period, and read by the path of that folder."""
    path = new_path(spark, "periods")
    writers.by_period(views.read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyMM").alias("period")), path)
    where = F.regexp_replace(F.col("_metadata.file_path"), "period=", "")
    return spark.read.parquet(path).select(X.period(where).alias("period")).groupBy("period").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer")
def attribute_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes with a key that must be unique, as JSON lines."""
    path = new_path(spark, "attributes")
    writers.attributes(views.read(spark, sf_dir, "customer").select("c_custkey", "c_name"), path, "c_custkey")
    return spark.read.schema("c_custkey bigint, c_name string").json(path)


@query(f"WITH {CLEANED} SELECT paper_id, paper_id || chr(10) || string_agg('(''' || subject || ''', ''' || predicate || ''', ''' || object || ''')---', '' ORDER BY pos) || chr(10) || repeat('-', 60) AS text FROM cleaned GROUP BY paper_id")
def triple_text_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.triple_dump(_cleaned(spark, sf_dir))


_one_word = " AND ".join(f"len({_tokens(c)}) <= 1" for c in ("subject", "predicate", "object"))


@query(f"WITH {CLEANED} SELECT paper_id, count(*) AS n FROM c4 GROUP BY paper_id HAVING count_if({_one_word}) = 0")
def emptied_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that only a limit of one word a part leaves without triples; they stay in nested triples."""
    judged = T.judged(_parsed(spark, sf_dir), Cleaning(stopwords=tuple(STOPWORDS), max_length=1))
    nested = T.nested(judged).filter(F.size("triplets") == 0).select("paper_id")
    return judged.join(nested, "paper_id", "left_semi").groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))


_base = "regexp_replace(regexp_replace(file_name, '\\.[A-Za-z]+$', ''), 'v\\d+$', '')"
_version = "regexp_extract(file_name, 'v(\\d+)\\.[A-Za-z]+$', 1)::INTEGER"


@query(f"WITH {views.PAPERS_SQL} SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_base}, categories ORDER BY {_version} DESC, file_name) AS r FROM papers) WHERE r = 1")
def newest_version_a_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.newest_versions(views.papers(spark, sf_dir), folder="categories").select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink = views.read(spark, sf_dir, "labels").filter("quality = 0")
    return selection.missing(views.read(spark, sf_dir, "documents").filter("lang = 'en'"), sink, "doc_id").select("doc_id")


def has_the(text: str) -> str:
    """A stand-in for a language detector; it fails on long texts that start with a capital, as models do on long input."""
    if len(text) > 1000 and text[:1] == "T":
        raise ValueError("too long")
    return "en" if " the " in text.replace("\n", " ") else "other"


@query("SELECT doc_id FROM documents WHERE contains(replace(CASE WHEN length(text) > 1000 AND text[1] = 'T' THEN substring(text, 1, 514) ELSE substring(text, 1, 1300) END, chr(10), ' '), ' the ')")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector's own limit on characters is its feature: the first 1300, or 514 after an error."""
    return selection.in_language(views.read(spark, sf_dir, "documents"), ["en"], has_the).select("doc_id")


@query("SELECT id, list_aggregate(categories, 'string_agg', '|') AS listed FROM (SELECT o_orderkey::VARCHAR AS id, string_split(o_orderstatus || ' ' || o_orderpriority, ' ') AS categories FROM orders WHERE o_orderkey % 7 <> 0)")
def category_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata rows; ids with letters are older ones and go."""
    ident = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("hep"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string"))
    rows = views.read(spark, sf_dir, "orders").select(ident.alias("id"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("categories"))
    return selection.category_rows(rows).select("id", F.array_join("categories", "|").alias("listed"))


@query(f"SELECT word, count(*) AS n FROM (SELECT item_id, word, count(*) AS k FROM (SELECT item_id, unnest({_tokens('lower(substring(text, 1, 300))')}) AS word FROM benchmark) GROUP BY ALL) WHERE k >= 2 GROUP BY word")
def truncated_book_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut of books to their first characters is the operator's feature."""
    return vocabulary.document_frequency(views.books(spark, sf_dir), 2, max_length=300)


_matrix = ", ".join(f"({a}, {b}, {d}::DOUBLE)" for a, b, d in vocabulary.ngram_distances(DISTANCES))


@query(f"WITH m(i, j, distance) AS (VALUES {_matrix}) SELECT p_partkey, distance FROM part JOIN m ON len(string_split(p_name, ' ')) = i AND len(string_split(p_brand || ' ' || p_type || repeat(' x', p_size % 6), ' ')) = j")
def ngram_distance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("left"), F.concat("p_brand", F.lit(" "), "p_type", F.repeat(F.lit(" x"), F.col("p_size") % 6)).alias("right"))
    return vocabulary.with_distance(pairs, DISTANCES).select("p_partkey", "distance")


@query("SELECT doc_id, replace(text, '&', '+') || '<b> & \"é\"' AS text FROM documents")
def html_unescaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = F.concat(F.regexp_replace("text", "&", "&#43;"), F.lit("&lt;b&gt; &amp; &quot;&eacute;&quot;"))
    return views.read(spark, sf_dir, "documents").select("doc_id", readers.unescaped(escaped).alias("text"))


_part = lambda c: f"nullif(nullif({c}, 'unknown'), '')"


@query(f"SELECT s_suppkey, trim(concat_ws(', ', {_part('s_name')}, {_part('city')}, {_part('country')})) AS name FROM (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN '' ELSE 'City' END AS city, 'N' || s_nationkey AS country FROM supplier)")
def organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    city = F.when(F.col("s_suppkey") % 3 == 0, "unknown").when(F.col("s_suppkey") % 3 == 1, "").otherwise("City")
    return views.read(spark, sf_dir, "supplier").select("s_suppkey", X.organisation(F.col("s_name"), city, F.concat(F.lit("N"), "s_nationkey")).alias("name"))


_models = list(batching.MARKERS)
_marked = "'no answer ' || role || {0} || 'first' || {0} || text"
_answers = ", ".join(f"list_extract(string_split({_marked.format(chr(39) + m + chr(39))}, '{m}'), -1) AS a{k}" for k, m in enumerate(batching.MARKERS.values()))


@query(f"SELECT conv_id, turn, {_answers} FROM conversations")
def answers_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda m: F.concat(F.lit("no answer "), "role", F.lit(m), F.lit("first"), F.lit(m), "text")
    return views.read(spark, sf_dir, "conversations").select("conv_id", "turn", *(batching.answer(said(batching.MARKERS[m]), m).alias(f"a{k}") for k, m in enumerate(_models)))


@query(
    """SELECT doc_id, text || chr(10) || (repeat('-', least(2, length(text))) || repeat('*', greatest(least(9, length(text)) - 2, 0)) || repeat('-', greatest(length(text) - 9, 0))) || chr(10)
|| 'Line: ' || doc_id || ', start: [2, 4], end: [5, 9], type: citation' || chr(10) || replace(text, ' ', '_') || chr(10) || chr(10) || chr(10) AS entry FROM documents"""
)
def change_log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = [F.array(F.lit(2), F.lit(4)), F.array(F.lit(5), F.lit(9))]
    return views.read(spark, sf_dir, "documents").select("doc_id", X.change_log(F.col("text"), F.translate("text", " ", "_"), F.col("doc_id"), *ends, "citation").alias("entry"))


@query("SELECT l_orderkey, l_linenumber, greatest(floor(l_extendedprice / (l_quantity * l_partkey + 1)), 1)::BIGINT AS batch FROM lineitem")
def batch_estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = F.col("l_quantity") * F.col("l_partkey") + 1
    return views.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", batching.estimated_batch(F.col("l_extendedprice"), needed).cast("bigint").alias("batch"))


_at = lambda curve, n: f"(SELECT regr_slope(y, x) * {n} + regr_intercept(y, x) FROM p WHERE curve = {curve})"


@query(f"WITH p AS (SELECT s_suppkey % 3 AS curve, s_suppkey::DOUBLE AS x, (s_suppkey % 3 + 1) * s_suppkey * 0.25::DOUBLE + 2 AS y FROM supplier) SELECT round(greatest({_at(0, 100)}, {_at(2, 150)} + {_at(1, 150)}), 6) AS gb, true AS good")
def memory_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    names = F.when(k == 0, "without cache").when(k == 1, "with cache").otherwise("cache size")
    points = views.read(spark, sf_dir, "supplier").select(names.alias("curve"), F.col("s_suppkey").cast("double").alias("x"), ((k + 1) * F.col("s_suppkey") * 0.25 + 2).alias("y"))
    gb, good = memory.needed(points, 100, 50)
    return spark.createDataFrame([(round(gb, 6), good)], "gb double, good boolean")


@query("SELECT round(0.9::DOUBLE * (SELECT c_acctbal FROM customer ORDER BY c_custkey LIMIT 1) - max(c_nationkey), 6) AS usable_gb FROM customer")
def usable_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for devices: the balance is a device's memory, the nation's number what it holds."""
    devices = views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device"), F.col("c_acctbal").alias("total_gb"), F.col("c_nationkey").alias("allocated_gb"))
    return memory.usable(devices).select(F.round("usable_gb", 6).alias("usable_gb"))


@query("SELECT sum(l_linenumber * l_partkey * 64)::DOUBLE / 1e9 AS billions FROM lineitem")
def parameter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stand for the tensors of a model."""
    tensors = views.read(spark, sf_dir, "lineitem").select(F.array(F.col("l_linenumber").cast("bigint"), F.col("l_partkey"), F.lit(64).cast("bigint")).alias("shape"))
    return memory.parameter_count(tensors)


@query(f"WITH {views.PAPERS_SQL}, {BODY} SELECT {_base} AS paper_id, list_aggregate(list_filter(string_split(body, chr(10)), lambda s: s <> ''), 'string_agg', '|') AS listed, len(list_filter(string_split(body, chr(10)), lambda s: s <> ''))::BIGINT AS n FROM bodies JOIN papers USING (doc_id) WHERE raw_text <> ''")
def loaded_with_own_splitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers loaded with a sentence splitter of the caller's own: one sentence a line."""
    lines = lambda c: F.filter(F.split(c, "\n"), lambda s: s != "")
    out = pipelines.loaded(views.papers(spark, sf_dir), Loading(split_sentences=lines))
    return out.select("paper_id", F.nullif(F.array_join("sentences", "|"), F.lit("")).alias("listed"), F.size("sentences").cast("bigint").alias("n"))


# --- patents: documents of all parts, from the columns of documents

_clean = "regexp_replace(replace(coalesce(text, ''), '&', '+'), '[\\x00-\\x08\\x0b-\\x1f]', '', 'g')"
PATENT_SQL = f"""
d AS (SELECT doc_id, {_clean} AS t, lang, source, doc_id % 4 AS k, CASE WHEN doc_id % 2 = 0 THEN 'grant' ELSE 'application' END AS kind, doc_id % 40 = 7 AS skipped, doc_id % 50 = 49 AS failed FROM documents),
r AS (SELECT *, 'G' AS s, lpad((doc_id % 90 + 10)::VARCHAR, 2, '0') AS c, CASE WHEN doc_id % 2 = 0 THEN 'F' ELSE 'K' END AS u, (doc_id % 400 + 1)::VARCHAR AS g, lpad((doc_id % 80 + 10)::VARCHAR, 2, '0') AS b FROM d),
records AS (SELECT 'US' || doc_id AS publication_number, substring(t, 1, 40) AS publication_title, '2020' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '07' AS publication_date, CASE WHEN kind = 'grant' THEN '20200101' END AS grant_date,
  (doc_id * 7)::VARCHAR AS application_number, CASE WHEN doc_id % 3 = 0 THEN 'utility' ELSE 'design' END AS application_type, '20190101' AS application_date, CASE WHEN kind = 'grant' THEN 'granted' ELSE 'pending' END AS application_status, 'uspto' AS patent_office,
  'First' || doc_id || ' Last' AS authors, 'Org ' || source || ', ' || upper(lang) AS organizations, 'At Torney' AS attorneys, 'Law' AS attorney_organizations, s AS sections, s || c AS section_classes, s || c || u AS section_class_subclasses, s || c || u || ' ' || g || '/' || b AS section_class_subclass_groups,
  trim(substring(t, 41, 120), chr(10)) AS abstract, trim(substring(t, 161), chr(10)) AS descriptions, 'claim one of ' || doc_id || '|' || trim(substring(t, 161, 60), chr(10)) AS claims, 'claim one of ' || doc_id || ' ' || trim(substring(t, 161, 60), chr(10)) AS claimed,
  CASE k WHEN 1 THEN 'continuation:G' || doc_id || ':US::false:C' || doc_id || ',FR,' || (doc_id + 1) || ',20180101|' WHEN 2 THEN 'provisional:' || (doc_id + 3) || ':US::false:20170101|' WHEN 3 THEN 'prior:' || (doc_id + 4) || ':US:A1:false:20160101|' ELSE '' END
    || 'patent-reference:' || (doc_id + 9) || ':EP:B:true:20150101,Name|other-reference:Book of ' || source || '::' || ':false:|other-reference:' || (doc_id + 5) || ':DE::false:20140101' AS refs, doc_id, skipped, failed
FROM r)"""


def _patent_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One XML document a row of documents, with all parts that a patent can have."""
    n = F.col("doc_id")
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "&", "+"), r"[\x00-\x08\x0b-\x1f]", "")
    esc = lambda c: F.regexp_replace(c, "<", "&lt;")
    code = F.format_string("G%d%s %d/%02d", n % 90 + 10, F.when(n % 2 == 0, "F").otherwise("K"), n % 400 + 1, n % 80 + 10)
    parts = F.format_string("<classifications-ipcr><classification-ipcr><section>G</section><class>%d</class><subclass>%s</subclass><main-group>%d</main-group><subgroup>%02d</subgroup></classification-ipcr></classifications-ipcr>", n % 90 + 10, F.when(n % 2 == 0, "F").otherwise("K"), n % 400 + 1, n % 80 + 10)
    ident = "<document-id><country>%s</country><doc-number>%s</doc-number>%s<date>%s</date></document-id>"
    related = (
        F.when(n % 50 == 49, F.lit("<unheard-of/>"))
        .when(n % 4 == 1, F.format_string(f"<continuation><relation><parent-doc>{ident.replace('%s', 'US', 1).replace('%s', 'P%d', 1).replace('%s', '', 1).replace('%s', '20180101')}<parent-grant-document><document-id><doc-number>G%d</doc-number></document-id></parent-grant-document></parent-doc><child-doc><document-id><country>FR</country><doc-number>C%d</doc-number></document-id></child-doc></relation></continuation>", n + 1, n, n))
        .when(n % 4 == 2, F.format_string("<us-provisional-application><document-id><country>US</country><doc-number>%d</doc-number><date>20170101</date></document-id></us-provisional-application>", n + 3))
        .when(n % 4 == 3, F.format_string("<related-publication><document-id><country>US</country><doc-number>%d</doc-number><kind>A1</kind><date>20160101</date></document-id></related-publication>", n + 4))
        .otherwise("")
    )
    kind = F.when(n % 2 == 0, "grant").otherwise("application")
    xml = F.concat(
        F.format_string('<us-patent-%s file="US%d-1.XML" date-produced="20200101"><us-bibliographic-data-%s>', kind, n, kind),
        F.format_string("<publication-reference><document-id><date>2020%02d07</date></document-id></publication-reference>", n % 12 + 1),
        F.format_string('<application-reference appl-type="%s"><document-id><doc-number>%d</doc-number><date>20190101</date></document-id></application-reference>', F.when(n % 3 == 0, "utility").otherwise("design"), n * 7),
        F.when(n % 3 == 0, parts).otherwise(F.concat(F.lit("<classifications-cpc><classification-cpc-text>"), code, F.lit("</classification-cpc-text></classifications-cpc>"))),
        F.lit("<invention-title>"), esc(F.substring(text, 1, 40)), F.lit("</invention-title><us-related-documents>"), related, F.lit("</us-related-documents>"),
        F.format_string("<us-references-cited><us-citation><patcit><document-id><country>EP</country><doc-number>%d</doc-number><kind>B</kind><name>Name</name><date>20150101</date></document-id></patcit><category>cited by examiner</category></us-citation>", n + 9),
        F.format_string("<us-citation><nplcit><othercit>Book of %s</othercit></nplcit><category>cited by applicant</category></us-citation></us-references-cited>", F.col("source")),
        F.format_string("<priority-claims><priority-claim><country>DE</country><doc-number>%d</doc-number><date>20140101</date></priority-claim></priority-claims>", n + 5),
        F.format_string("<us-parties><us-applicants><us-applicant><addressbook><orgname>Org %s</orgname><city>unknown</city><country>%s</country></addressbook></us-applicant></us-applicants>", F.col("source"), F.upper("lang")),
        F.format_string('<inventors><inventor><addressbook><last-name>Last</last-name><first-name>First%d</first-name></addressbook></inventor></inventors><agents><agent rep-type="attorney"><addressbook><orgname>Law</orgname><first-name>At</first-name><last-name>Torney</last-name></addressbook></agent></agents></us-parties>', n),
        F.format_string("</us-bibliographic-data-%s>", kind), F.lit("<abstract>"), esc(F.substring(text, 41, 120)), F.lit("</abstract><description>"), esc(F.substring(text, F.lit(161), F.length(text))), F.lit("</description><claims><claim>claim one of "), n.cast("string"), F.lit("</claim><claim>"), esc(F.substring(text, 161, 60)), F.lit("</claim></claims>"),
        F.format_string("</us-patent-%s>", kind),
    )
    return views.read(spark, sf_dir, "documents").select(F.when(n % 40 == 7, F.lit("<sequence-cwu/>")).otherwise(xml).alias("xml"))


_single = "publication_number publication_title publication_date grant_date application_number application_type application_date application_status patent_office".split()
_listed = "authors organizations attorneys attorney_organizations sections section_classes section_class_subclasses section_class_subclass_groups abstract descriptions claims".split()
_ok = "WHERE NOT skipped AND NOT failed"


def _good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patents.parsed(_patent_documents(spark, sf_dir)).filter("error IS NULL AND NOT skipped")


@query(f"WITH {PATENT_SQL} SELECT {', '.join(_single + _listed)}, refs FROM records {_ok}")
def patent_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of patents; related documents and citations as type:reference:country:kind:examiner:metadata."""
    refs = lambda r: F.array_join(F.array(*(F.coalesce(r[c].cast("string"), F.lit("")) for c in ("document_type", "reference", "country", "kind", "cited_by_examiner")), _meta(r)), ":")
    return _good(spark, sf_dir).select(*_single, *(F.array_join(c, "|").alias(c) for c in _listed), F.array_join(F.transform("referential_documents", refs), "|").alias("refs"))


def _meta(r: F.Column) -> F.Column:
    """Values of the metadata of a related document, in the order of their keys here; a number that is the parent's own loses its letter."""
    keys = ("child_application_number", "parent_country", "application_number", "application_date", "date", "name")
    values = [F.regexp_replace(r["metadata"][k], "^P", "") if k == "application_number" else r["metadata"][k] for k in keys]
    return F.array_join(F.array_compact(F.array(*values)), ",")


@query(f"WITH {PATENT_SQL} SELECT count_if(NOT skipped AND NOT failed)::BIGINT AS n_success, count_if(failed AND NOT skipped)::BIGINT AS n_failed, count_if(skipped)::BIGINT AS n_skipped FROM records")
def patent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patents.counts(patents.parsed(_patent_documents(spark, sf_dir)))


@query(f"WITH {PATENT_SQL} SELECT publication_number, substring(publication_date, 3, 4) AS period, publication_title || ' ' || abstract || ' ' || claimed || ' ' || descriptions AS text FROM records {_ok} AND contains(lower(publication_title || ' ' || abstract || ' ' || claimed), 'und')")
def patent_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the patents with a keyword."""
    return pipelines.patents_to_texts(_patent_documents(spark, sf_dir), ["und"])[0]


@query(f"WITH {PATENT_SQL} SELECT publication_number, publication_title, grant_date, section_class_subclass_groups AS groups, (doc_id % 4 > 0)::BIGINT + 3 AS n_cited FROM records {_ok} AND contains(lower(publication_title || ' ' || abstract || ' ' || claimed), 'und')")
def patent_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen attributes; related documents as the numbers of the records that hold them."""
    found = pipelines.patents_to_texts(_patent_documents(spark, sf_dir), ["und"])[1]
    own = F.size(F.filter("referential_documents", lambda r: r == F.col("publication_number")))
    return found.select("publication_number", "publication_title", "grant_date", F.array_join("section_class_subclass_groups", "|").alias("groups"), own.cast("bigint").alias("n_cited"))
