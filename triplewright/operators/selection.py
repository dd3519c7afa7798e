"""Choice of papers: categories, versions, periods, terms, samples and what is done already."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def in_categories(df: DataFrame, categories: list[str], inverse: bool = False, column: str = "categories") -> DataFrame:
    """Rows with one of the categories, or with inverse those with none. No categories keep nothing, or all with inverse."""
    wanted = F.array(*map(F.lit, categories)) if categories else F.array().cast("array<string>")
    any_of = F.arrays_overlap(X.tokens(F.coalesce(column, F.lit(""))), wanted)
    return df.filter(~any_of if inverse else any_of)


def newest_versions(df: DataFrame, name: str = "file_name", folder: str | None = None) -> DataFrame:
    """The newest version of each paper, in each folder if one is given; ties keep the first name."""
    keys = [X.base_id(F.col(name)), *([F.col(folder)] if folder else [])]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(X.version(F.col(name)).desc_nulls_last(), name))
    return df.withColumn("__place", place).filter("__place = 1").drop("__place")


def max_versions(df: DataFrame, name: str = "file_name") -> DataFrame:
    return df.groupBy(X.base_id(F.col(name)).alias("base")).agg(F.max(X.version(F.col(name))).alias("version"))


def not_done(df: DataFrame, done: DataFrame, name: str = "file_name") -> DataFrame:
    """Papers no version of which is done."""
    seen = done.select(X.base_id(F.col(name)).alias("__base")).distinct()
    return df.withColumn("__base", X.base_id(F.col(name))).join(seen, "__base", "left_anti").drop("__base")


def listing(files: DataFrame, done: DataFrame | None = None, kept: DataFrame | None = None, newest_only: bool = False, name: str = "file_name") -> DataFrame:
    """Files that are not done, whose paper is in kept (id), in the newest version."""
    out = files if done is None else not_done(files, done, name)
    if kept is not None:
        ids = kept.select(F.col("id").alias("__base")).distinct()
        out = out.withColumn("__base", X.base_id(F.col(name))).join(ids, "__base", "left_semi").drop("__base")
    return newest_versions(out, name) if newest_only else out


def missing(df: DataFrame, sink: DataFrame, key: str) -> DataFrame:
    return df.join(sink.select(key).distinct(), key, "left_anti")


def with_terms(df: DataFrame, terms: list[str], text: str = "text", average: int = 1250, ignore_case: bool = True) -> DataFrame:
    """Papers whose abstract holds one of the terms."""
    return df.filter(X.contains_any(X.abstract(F.col(text), average, ignore_case), terms, ignore_case))


def non_empty(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(F.col(text) != "")


def empty_share(df: DataFrame, text: str = "text") -> DataFrame:
    empty = F.coalesce(F.col(text), F.lit("")) == ""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(empty).alias("n_empty"), (100.0 * F.count_if(empty) / F.count(F.lit(1))).alias("percent_empty"))


def category_rows(df: DataFrame) -> DataFrame:
    """id and categories of metadata rows whose id has no letters."""
    return df.filter(~F.rlike("id", F.lit("[a-zA-Z]"))).select("id", F.split("categories", " ").alias("categories"))


def in_language(df: DataFrame, languages: list[str], detect: Callable[[str], str], text: str = "text", chars: int = 1300, retry: int = 514) -> DataFrame:
    """Rows in one of the languages by detect over the first characters, over fewer after an error; a second error gives 'err'."""

    def one(x: str | None) -> str:
        for n in (chars, retry):
            try:
                return detect((x or "")[:n])
            except Exception:
                continue
        return "err"

    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in it:
            yield column.map(one)

    return df.filter(run(F.col(text)).isin(languages))


def sample(df: DataFrame, size: float | None, key: str, seed: int = 42) -> DataFrame:
    """A fixed share (size < 1, rounded down) or number of rows in the order of md5(key:seed); None keeps all.

    Rows are counted by the first four digits of the hash; only those of the last bucket that is needed are sorted.
    """
    if size is None:
        return df
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    d = df.withColumn("__hash", h)
    bucket = F.substring("__hash", 1, 4)
    counts = sorted((r[0] or "", r[1]) for r in d.groupBy(bucket.alias("b")).count().collect())  # 65,536 and null at most
    total = sum(n for _, n in counts)
    left = int(size * total) if size < 1 else int(size)
    if left >= total:
        return df
    last = ""
    for last, n in counts:  # noqa: B007
        if n > left:
            break
        left -= n
    place = F.coalesce(bucket, F.lit(""))
    edge = d.filter(place == last).orderBy("__hash", key).limit(left)
    return d.filter(place < last).unionByName(edge).drop("__hash")


def first_of_each_period(df: DataFrame, n: int | None, period: str = "period", order: str = "path") -> DataFrame:
    if n is None:
        return df
    place = F.row_number().over(Window.partitionBy(period).orderBy(order))
    return df.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")


def share(kept: Column) -> Column:
    """Percentage of rows for which kept holds."""
    return 100.0 * F.count_if(kept) / F.count(F.lit(1))
