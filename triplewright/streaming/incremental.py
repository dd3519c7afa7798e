"""Incremental runs: only new files are processed, and each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of paper_id and text of text files that arrive in a folder."""
    return spark.readStream.option("wholetext", True).text(folder).select(F.col("_metadata.file_name").alias("paper_id"), F.col("value").alias("text"))


def run_available(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Process what has arrived since the last call and append it to a Parquet table; the checkpoint remembers what is done."""
    query = transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
