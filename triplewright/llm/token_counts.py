"""Token counts of whole texts by Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from .tokenizer_units import Units

_open: dict[str, Units] = {}


def _count(path: str, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    units = _open.get(path) or _open.setdefault(path, Units(path, ids=False))
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        n = pa.array(units.encode(texts), pa.int64())
        size = pa.array(map(len, texts), pa.int64())
        yield pa.record_batch([batch.column(0), size, n, pa.compute.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row.

    tokenizer: path of a tokenizers JSON file. Counts are those of the library over the whole text without begin, end
    or added special tokens; special strings inside a text count as the library's default has them. Texts are cut at
    safe boundaries, distinct pieces are encoded in batches of about equal bytes, and only lengths leave the function.
    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids are kept as they are; other columns are
    not read. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return docs.select(id_col, text_col).mapInArrow(partial(_count, tokenizer, limit), schema)
