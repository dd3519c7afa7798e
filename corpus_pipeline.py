"""A corpus pipeline over documents: quality, boilerplate lines, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triplewright.llm.best_fit_packing import pack
from triplewright.llm.common import read, release, stage
from triplewright.llm.line_dedup import drop_boilerplate
from triplewright.llm.quality_classifier import drop_low_quality
from triplewright.llm.queries import vocabulary
from triplewright.llm.simhash_dedup import drop_near_duplicates
from triplewright.llm.substring_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7, which the classifier marks 0, go."""
    return drop_low_quality(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on 10 or more sources stay in the earliest document only; all documents stay."""
    return drop_boilerplate(docs, min_sites=10)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are linked by a Jaccard similarity of 0.8 or more stays."""
    return drop_near_duplicates(docs, width=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document has are cut out; all documents stay."""
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024 with the places of each document's pieces."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_dedup", near_duplicates),
    ("substring_dedup", passages),
    ("best_fit_packing", packing),
]

# Hashed models, linked groups and tokenizers are beyond SQL; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each over the written result of the one before."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES[:-1]):
        before, docs = docs, stage(step(spark, docs, sf_dir), name)
        if k:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
