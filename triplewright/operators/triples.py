"""From model answers to clean triples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Cleaning
from ..functions import triples as T


def english_stopwords() -> list[str]:
    return list(StopWordsRemover.loadDefaultStopWords("english"))


def parsed(answers: DataFrame) -> DataFrame:
    """paper_id, pos, subject, predicate, object of the triples in answers (paper_id, triplets, chunk_no).

    pos counts through all rows of a paper, in the order of chunk_no, so (paper_id, pos) names a triple. Without
    chunk_no a paper's rows are taken in the order of their text. Rows without triples are left out. Answers are shuffled
    as they are and parsed afterwards, so that rows, not triples, are sorted, and numbers run on from row to row.
    """
    order = "chunk_no" if "chunk_no" in answers.columns else "triplets"
    said = answers.filter(F.col("triplets").isNotNull()).select("paper_id", F.col(order).alias("row"), "triplets").repartition("paper_id")
    found = said.select("paper_id", "row", T.parse(F.col("triplets")).alias("found"))
    earlier = Window.partitionBy("paper_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.select("paper_id", "found", F.coalesce(F.sum(F.size("found")).over(earlier), F.lit(0)).alias("first"))
    numbered = placed.select("paper_id", "first", F.posexplode("found").alias("k", "t"))
    return numbered.select("paper_id", (F.col("first") + F.col("k")).cast("int").alias("pos"), "t.*")


def mapped(df: DataFrame, f: Callable, fields: tuple[str, ...] = T.FIELDS) -> DataFrame:
    return df.withColumns({c: f(F.col(c)) for c in fields})


def once(df: DataFrame) -> DataFrame:
    """df through a generator of one row: filters above it read its values instead of computing them again."""
    return df.select(F.inline(F.array(F.struct(*(F.col(c) for c in df.columns)))))


def filled(df: DataFrame) -> DataFrame:
    return df.filter("subject <> '' AND object <> ''")


def drop_stopwords(df: DataFrame, fillers: list[str], stopwords: list[str], trim: bool = False) -> DataFrame:
    """Subjects and objects without stopwords, predicates without fillers; triples that lose a subject or object go."""
    out = mapped(df, lambda c: T.without(c, stopwords), ("subject", "object"))
    return filled(once(out.withColumn("predicate", T.lean_predicate(F.col("predicate"), fillers, trim))))


def lemmatised(df: DataFrame, lemmatise: Callable[[str], str] | None) -> DataFrame:
    """All parts through lemmatise, one call a distinct text of a batch; None leaves them."""
    if lemmatise is None:
        return df

    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in it:
            known = {x: lemmatise(x) for x in column.dropna().unique()}
            yield column.map(known)

    return mapped(df, run)


def lemmatised_text(text: str, lemmatise: Callable[[str], str]) -> str:
    """Lemmas of the words of a text, without marks that stand alone."""
    return " ".join(lemmatise(w) for w in text.split() if any(c.isalnum() for c in w))


def long_terms(df: DataFrame, least: int) -> DataFrame:
    return filled(once(mapped(df, lambda c: T.long_words(c, least), ("subject", "object"))))


def not_repeated(df: DataFrame) -> DataFrame:
    return mapped(df, T.no_repeats, ("subject", "object"))


def is_short(most: int) -> Column:
    return T.short(F.col("subject"), most) & T.short(F.col("predicate"), most) & T.short(F.col("object"), most)


def short_parts(df: DataFrame, most: int) -> DataFrame:
    return df.filter(is_short(most))


def judged(df: DataFrame, settings: Cleaning | None = None, lemmatise: Callable[[str], str] | None = None) -> DataFrame:
    """All cleaning steps in order; kept says whether a triple passes the last one, the limit on words a part.

    A paper that earlier steps empty is gone; one whose triples are all too long is still there, without kept ones.
    """
    s = settings or Cleaning()
    stopwords = english_stopwords() if s.stopwords is None else list(s.stopwords)
    out = drop_stopwords(mapped(df, T.plain), list(s.filler_verbs), stopwords, s.trim)
    out = long_terms(lemmatised(out, lemmatise if s.use_lemmatization else None), s.min_num_characters)
    return once(not_repeated(out).withColumn("kept", is_short(s.max_length)))


def cleaned(df: DataFrame, settings: Cleaning | None = None, lemmatise: Callable[[str], str] | None = None) -> DataFrame:
    """The triples that judged() keeps; papers without any are not among them, see nested() and summary() of judged()."""
    return judged(df, settings, lemmatise).filter("kept").drop("kept")


def _kept(df: DataFrame) -> Column:
    return F.col("kept") if "kept" in df.columns else F.lit(True)


def nested(df: DataFrame) -> DataFrame:
    """paper_id and triplets in order; of judged triples the kept ones, so that a paper may have none."""
    every = F.array_sort(F.collect_list(F.when(_kept(df), F.struct("pos", *T.FIELDS))))
    return df.groupBy("paper_id").agg(F.transform(every, lambda x: F.struct(*(x[f].alias(f) for f in T.FIELDS))).alias("triplets"))


def flat(df: DataFrame) -> DataFrame:
    return df.select("paper_id", F.posexplode("triplets").alias("pos", "t")).select("paper_id", "pos", "t.*")


def summary(df: DataFrame) -> DataFrame:
    """Papers, triples and triples a paper; of judged triples the kept ones over all their papers."""
    papers = df.groupBy("paper_id").agg(F.count_if(_kept(df)).alias("n"))
    total = papers.agg(F.count(F.lit(1)).alias("n_papers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_triples"))
    return total.withColumn("triples_a_paper", F.try_divide("n_triples", "n_papers"))


def graph(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (term, degree) and edges (source, predicate, target, n) of triples."""
    edges = df.groupBy(F.col("subject").alias("source"), "predicate", F.col("object").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    ends = df.select(F.explode(F.array("subject", "object")).alias("term"))
    return ends.groupBy("term").agg(F.count(F.lit(1)).alias("degree")), edges
