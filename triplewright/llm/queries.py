"""Queries opN_<name> and pipeline over the synthetic tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import sign_code, top_k

    rows = read(spark, sf_dir, "embeddings").select("vec_id", sign_code(F.col("embedding")).alias("code"))
    return top_k(rows, rows.filter("vec_id % 20 = 0"), k=10)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_removals

    return line_removals(read(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(read(spark, sf_dir, "documents"))


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .best_fit_packing import pack

    return pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import removal_digest

    return removal_digest(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_exact_topk_search,
        op3_line_dedup,
        op4_license_scan,
        op5_bpe_encode_decode,
        op6_best_fit_packing,
        op7_token_counts,
        op8_simhash_dedup,
        op9_substring_dedup,
        op10_quality_rules,
        pipeline,
    )
}

from .oracles import ORACLE_SQL  # noqa: E402, F401
