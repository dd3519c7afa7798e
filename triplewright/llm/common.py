"""Helpers that the corpus operators share: staged tables, skew-safe lookups and text conventions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import drop_staged, release, shared_dir, stage  # noqa: F401

# ASCII white space of the word definition [^\x20\x09-\x0D]+, as a regex class body and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
HOT_KEYS = 1000

def lookup(left: DataFrame, table: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join left to table on key where a few keys may hold most of left's rows.

    table has one row a key; its column weight says how many rows of left have that key, and total how many
    rows left has. Keys above total / HOT_KEYS, of which there can be HOT_KEYS at most, are broadcast; all others
    are joined by a shuffle in which no key is large. weight is dropped. how: inner or left_semi.
    """
    least = max(2, total // HOT_KEYS)
    hot = F.broadcast(table.filter(F.col(weight) > least).drop(weight))
    cold = table.filter(F.col(weight) <= least).drop(weight)
    rest = left.join(F.broadcast(table.filter(F.col(weight) > least).select(key)), key, "left_anti")
    return left.join(hot, key, how).unionByName(rest.join(cold, key, how))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, wherever the optimiser moves or copies the expression."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def row_key(*columns: str) -> Column:
    """A key of 64 bits for rows whose ids may be null or repeated; equal rows share it."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns])


def tidy() -> None:
    """Give freed memory of this Python worker back, which lives on between tasks and shares its machine with the JVM."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def free(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
