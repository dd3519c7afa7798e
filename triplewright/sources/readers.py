"""Readers of documents, metadata, answers, patents and constants."""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

DECLARATION = '<?xml version="1.0" encoding="UTF-8"?>'


def pdf_files(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    """path and file_name of PDF files below one or more folders; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(roots)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"))


def pdf_texts(spark: SparkSession, roots: str | list[str], reader: Callable[[bytes, int], str], max_pages: int = 100) -> DataFrame:
    """path and text of PDF files; reader takes the bytes and a number of pages, and its errors give ''."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(content: bytes) -> str:
            try:
                return reader(content, max_pages)
            except Exception:
                return ""

        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [one(bytes(c)) for c in b["content"]]})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(roots)
    return found.select("path", "content").mapInPandas(run, "path string, text string")


def text_files(spark: SparkSession, folder: str, done: DataFrame | None = None) -> DataFrame:
    """paper_id (file name) and text of text files that are not empty, without those whose paper_id is in done."""
    found = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("paper_id"), F.col("value").alias("text"))
    return found if done is None else found.join(done.select("paper_id").distinct(), "paper_id", "left_anti")


def metadata(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(schema.METADATA).json(path)


def answers(spark: SparkSession, path: str | list[str], numbered: bool = False) -> DataFrame:
    """Rows of answer CSV files, without those that have no triples; if numbered with chunk_no, their order within each file."""
    found = spark.read.schema(schema.RAW_OUTPUT).csv(path, header=True, multiLine=True, escape='"')
    rows = found.withColumn("chunk_no", F.monotonically_increasing_id()) if numbered else found
    return rows.filter(F.col("triplets").isNotNull())


def table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table: triples, counts, entropies or books."""
    return spark.read.parquet(path)


def xml_files(spark: SparkSession, folders: str | list[str]) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).load(folders)
    return found.select("path")


def xml_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file and xml of each document of concatenated XML files, cut at the XML declaration by the reader."""
    found = spark.read.option("lineSep", DECLARATION).option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).text(path)
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("xml")).filter(F.trim("xml") != "")


def unescaped(text: F.Column) -> F.Column:
    """HTML entities replaced."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else html.unescape(x))

    return run(text)


def json_lines(lines: DataFrame, ddl: str = schema.PATENT, column: str = "value") -> DataFrame:
    """Parsed lines, and corrupt (the line) where one can't be parsed; nothing is dropped."""
    parsed = lines.select(column, F.from_json(column, f"{ddl}, __corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}).alias("r"))
    return parsed.select("r.*").withColumnRenamed("__corrupt", "corrupt")


def partition_paths(roots: Iterable[str], years: Iterable[int], months: Iterable[int]) -> list[str]:
    """Folders root/YYMM of all years and months, for readers that take lists of paths."""
    return [f"{root.rstrip('/')}/{y % 100:02d}{m:02d}" for root in roots for y in years for m in months]


def footprints(spark: SparkSession, path: str) -> DataFrame:
    """curve, x and y of a memory footprint file."""
    read = spark.read.text(path, wholetext=True).select(F.from_json("value", schema.FOOTPRINT).alias("m"))
    return read.select(F.explode("m").alias("curve", "points")).select("curve", F.explode("points").alias("x", "y")).select("curve", F.col("x").cast("double").alias("x"), "y")


def examples(path: str) -> list[dict[str, str]]:
    """Messages of a chat file."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)
