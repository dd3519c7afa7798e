"""Removal of boilerplate lines that spread over many sites, with HyperLogLog sketches of the sites of each line."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, free, let, lookup, release, row_key, stage

LG_K = 10  # a sketch of up to 2 ** LG_K registers: a standard error of about 3.3 % once it is full
SIGMAS = 4  # estimates within so many standard errors of the threshold are counted exactly


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(line: Column) -> Column:
    """The line without ASCII white space at its ends."""
    return F.call_function("btrim", line, F.lit(SPACE_CHARS))


def line_rows(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """key (of the row), doc_id, site, pos and h (hash of the trimmed line) of each line with a word."""
    keyed = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), F.col(site_col).cast("string").alias("site"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    return keyed.withColumn("line", _trimmed(F.col("line"))).filter("line <> ''").select("key", "doc_id", "site", "pos", F.xxhash64("line").alias("h"))


def boilerplate(lines: DataFrame, min_sites: int) -> tuple[DataFrame, int]:
    """h, n (occurrences) and first (doc_id, key and pos of the earliest) of lines on min_sites or more sites; and the number of all lines.

    Sketches are merged by partial aggregation, so a line that a third of all rows hold reaches its reducer as one
    sketch a task. Lines whose estimate lies near the threshold get an exact count of distinct sites.
    """
    total = lines.count()
    margin = max(1.0, SIGMAS * 1.04 / math.sqrt(1 << LG_K) * min_sites)
    site = F.coalesce("site", F.lit(""))
    sketched = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg(site, LG_K)).alias("estimate"), F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "pos")).alias("first"))
    spread = stage(sketched.filter(F.col("estimate") >= min_sites - margin), "spread")
    near = spread.filter(F.col("estimate") <= min_sites + margin).select("h", "n")
    counted = lookup(lines.select("h", site.alias("site")), near, "h", "n", total, "left_semi").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("sites"))
    exact = spread.join(counted, "h", "left").filter(F.coalesce("sites", F.col("estimate")) >= min_sites)
    table = stage(exact.select("h", "n", "first"), "boilerplate")
    release(spread)
    return table, total


def _marks(docs: DataFrame, min_sites: int, keep_first: bool, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """key and gone (ascending line positions) of each distinct row that loses a line.

    Texts are split and hashed once; sketches, exact counts and hits all read the staged hashes.
    """
    lines = stage(line_rows(docs, id_col, text_col, site_col), "lines")
    table, total = boilerplate(lines, min_sites)
    hits = lookup(lines.select("key", "doc_id", "pos", "h"), table, "h", "n", total)
    if keep_first:
        hits = hits.filter(~((F.col("key") == F.col("first.key")) & (F.col("pos") == F.col("first.pos"))))
    gone = stage(hits.groupBy("key").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "gone")
    release(lines, table)
    return gone


def _without(lines: Column, gone: Column) -> Column:
    """The lines between the positions in gone, in one pass."""
    last = F.size(gone)
    begin = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.element_at(gone, F.greatest(j, F.lit(1))) + 1)
    end = lambda j: F.when(j == last, F.size(lines)).otherwise(F.element_at(gone, F.least(j + 1, last)))
    return F.flatten(F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(lines, begin(j) + 1, end(j) - begin(j))))


def drop_boilerplate(docs: DataFrame, min_sites: int = 10, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs, all rows and columns, without the lines that are on min_sites or more distinct sites.

    Lines end at \\n and are compared without ASCII white space at their ends, by a 64-bit hash; lines without a word
    stay. With keep_first the earliest occurrence (least doc_id, then position; null ids last) of a line stays, so that
    no content leaves the corpus. Null sites count as one site. Texts without such lines are unchanged, null texts stay
    null; rows repeated as a whole are treated alike. Columns of any other name pass through. An empty table gives an
    empty result.
    """
    marks = _marks(docs, min_sites, keep_first, id_col, text_col, site_col)
    key, gone = free(docs, "key"), free(docs, "gone")
    joined = docs.withColumn(key, row_key(id_col, text_col)).join(marks.toDF(key, gone).hint("merge"), key, "left")
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(let(_lines(F.col(text_col)), lambda x: F.array_join(_without(x, F.col(gone)), "\n")))
    return joined.withColumn(text_col, text).select(*docs.columns)


def line_removals(docs: DataFrame, min_sites: int = 10, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """doc_id, n_lines (with a word), n_removed and kept_md5 (of the text that drop_boilerplate leaves) of each row; a null text counts as empty."""
    plain = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    marks = _marks(docs, min_sites, keep_first, id_col, text_col, site_col)
    lines = _lines(F.col("text"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(lines, lambda x: F.array_join(_without(x, F.col("gone")), "\n")))
    n = F.size(F.filter(lines, lambda x: _trimmed(x) != ""))
    return plain.join(marks.hint("merge"), "key", "left").select("doc_id", n.cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"), F.md5(kept.cast("binary")).alias("kept_md5"))
