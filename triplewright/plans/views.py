"""Papers, answers, books and patents made of the documents table, on which the queries run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _file_name(suffix: str) -> F.Column:
    k = F.floor(F.col("doc_id") / 2)
    return F.format_string("%02d%02d.%05dv%d." + suffix, 20 + k % 4, 1 + k % 12, k, 1 + F.col("doc_id") % 2)


PER_ANSWER = 15


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, chunk_no and triplets: triples of six words of each whole document, PER_ANSWER of them an answer row."""
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    none = F.array().cast("array<string>")
    six = lambda w, i: [F.element_at(w, 6 * i + k) for k in range(1, 7)]
    every = lambda w: F.when(F.size(w) >= 6, F.transform(F.sequence(F.lit(0), F.floor(F.size(w) / 6).cast("int") - 1), lambda i: F.concat(*(x for mark, word in zip(("(", " ", "; ", " ", "; ", " "), six(w, i), strict=True) for x in (F.lit(mark), word)), F.lit(")")))).otherwise(none)
    rows = lambda t: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(t) / PER_ANSWER).cast("int") - 1, F.lit(0))), lambda c: F.array_join(F.slice(t, c * PER_ANSWER + 1, PER_ANSWER), ", "))
    return read(spark, sf_dir, "documents").select(_file_name("txt").alias("paper_id"), F.posexplode(let(let(words, every), rows)).alias("chunk_no", "triplets"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, file_name, categories and raw_text with the marks that text operators look for."""
    m = F.col("doc_id")
    raw = F.concat(
        F.lit("Title page "),
        F.when((m % 4).isin(0, 1), "Abstract ").otherwise(""),
        F.substring("text", 1, 300),
        F.when((m % 4).isin(0, 2), " Introduction ").otherwise(" "),
        F.lit("pre- amble see [12] and (Smith, 2020) or [1, 2] "),
        F.col("text"),
        F.when(m % 3 == 0, " Acknowledgement thanks").otherwise(""),
        F.when(m % 5 != 0, " References [1] x").otherwise(""),
    )
    return read(spark, sf_dir, "documents").select("doc_id", _file_name("pdf").alias("file_name"), F.concat_ws(" ", "source", "lang").alias("categories"), raw.alias("raw_text"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("book_id"), "text")


def labelled_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("category"), "text")


def patent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patent-like records of whole documents: title, abstract, claims, descriptions and a classification string."""
    d = read(spark, sf_dir, "documents")
    part = lambda a, n: F.substring("text", a, n)
    code = F.format_string("%sG%02d%s %d/%02d", F.lit(""), F.col("doc_id") % 90 + 1, F.when(F.col("doc_id") % 2 == 0, "F").otherwise("K"), F.col("doc_id") % 400 + 1, F.col("doc_id") % 80 + 10)
    rest = F.expr("substring(text, 521)")
    half = F.floor(F.length(rest) / 2).cast("int")
    claims = F.array(part(221, 100), F.substring(rest, F.lit(1), half))  # the rest is half claims, half description
    return d.select(F.col("doc_id").cast("string").alias("publication_number"), part(1, 40).alias("publication_title"), F.array(part(41, 120), part(161, 60)).alias("abstract"), claims.alias("claims"), F.array(part(321, 200), F.substring(rest, half + 1, F.length(rest))).alias("descriptions"), code.alias("code"))


TOKENS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
FILE = "printf('%02d%02d.%05dv%d.{0}', 20 + (doc_id // 2) % 4, 1 + (doc_id // 2) % 12, doc_id // 2, 1 + doc_id % 2)"
ANSWERS_SQL = f"""
answers AS (SELECT {FILE.format('txt')} AS paper_id, chunk_no,
    array_to_string(list_transform(range(chunk_no * {PER_ANSWER}, least(chunk_no * {PER_ANSWER} + {PER_ANSWER}, len(w) // 6)), lambda i: '(' || w[6*i+1] || ' ' || w[6*i+2] || '; ' || w[6*i+3] || ' ' || w[6*i+4] || '; ' || w[6*i+5] || ' ' || w[6*i+6] || ')'), ', ') AS triplets
  FROM (SELECT doc_id, w, unnest(range(0, greatest((len(w) // 6 - 1) // {PER_ANSWER}, 0) + 1)) AS chunk_no FROM (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents)))"""
PAPERS_SQL = f"""
papers AS (SELECT doc_id, {FILE.format('pdf')} AS file_name, source || ' ' || lang AS categories,
    'Title page ' || CASE WHEN doc_id % 4 IN (0, 1) THEN 'Abstract ' ELSE '' END || substring(text, 1, 300) || CASE WHEN doc_id % 4 IN (0, 2) THEN ' Introduction ' ELSE ' ' END
    || 'pre- amble see [12] and (Smith, 2020) or [1, 2] ' || text || CASE WHEN doc_id % 3 = 0 THEN ' Acknowledgement thanks' ELSE '' END || CASE WHEN doc_id % 5 <> 0 THEN ' References [1] x' ELSE '' END AS raw_text
  FROM documents)"""
PATENTS_SQL = """
patents AS (SELECT doc_id::VARCHAR AS publication_number, substring(text, 1, 40) AS publication_title, [substring(text, 41, 120), substring(text, 161, 60)] AS abstract,
    [substring(text, 221, 100), substring(substring(text, 521), 1, (length(substring(text, 521)) // 2)::INTEGER)] AS claims,
    [substring(text, 321, 200), substring(substring(text, 521), (length(substring(text, 521)) // 2 + 1)::INTEGER)] AS descriptions, printf('G%02d%s %d/%02d', doc_id % 90 + 1, CASE WHEN doc_id % 2 = 0 THEN 'F' ELSE 'K' END, doc_id % 400 + 1, doc_id % 80 + 10) AS code FROM documents)"""
