"""Writers. Task commits replace flushing and clean-up; modes replace clearing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def texts(df: DataFrame, path: str, lines: str = "sentences", mode: str = "overwrite") -> None:
    """paper_id and text, one line a sentence."""
    df.select("paper_id", F.array_join(lines, "\n").alias("text")).write.mode(mode).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def triple_dump(triples: DataFrame) -> DataFrame:
    """paper_id and text of a readable dump: the id, a line of the triples, each before ---, and a rule."""
    one = F.concat(F.lit("("), F.concat_ws(", ", *(F.concat(F.lit("'"), F.col(c), F.lit("'")) for c in ("subject", "predicate", "object"))), F.lit(")---"))
    listed = triples.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("line")))).alias("l"))
    return listed.select("paper_id", F.concat(F.col("paper_id"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit("\n" + "-" * 60)).alias("text"))


def words(df: DataFrame, path: str) -> None:
    df.select("word").write.mode("overwrite").text(path)


def json_rows(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def by_period(df: DataFrame, path: str, period: str = "period") -> None:
    df.write.mode("overwrite").partitionBy(period).parquet(path)


def attributes(df: DataFrame, path: str, key: str = "publication_number") -> None:
    """Write rows whose key is unique; ValueError names a repeated one."""
    twice = df.groupBy(key).count().filter("count > 1").select(key).head()
    if twice:
        raise ValueError(f"{key} {twice[0]} occurs more than once")
    df.write.mode("overwrite").json(path)
