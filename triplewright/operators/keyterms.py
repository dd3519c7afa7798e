"""Key terms of abstracts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def with_key_term(df: DataFrame, terms: list[str], text: str = "text", average: int = 2000) -> DataFrame:
    """Papers whose abstract holds a term, in the same case."""
    return df.filter(X.contains_any(X.abstract(F.col(text), average, False), terms, False))


@lru_cache(maxsize=1 << 18)
def _place(trigram: str, size: int) -> int:
    return int.from_bytes(hashlib.md5(trigram.encode()).digest()[:4], "little") % size


def hashed_embedding(texts: list[str], size: int = 64) -> np.ndarray:
    """Deterministic stand-in for an embedding model: counts of hashed character trigrams."""
    places = [[_place(t[k : k + 3], size) for k in range(max(1, len(t) - 2))] for t in texts]
    rows = np.repeat(np.arange(len(texts)), [len(p) for p in places])
    return np.bincount(rows * size + np.concatenate([np.array(p, np.int64) for p in places]), minlength=len(texts) * size).reshape(-1, size).astype(float)


def keywords(df: DataFrame, embed: Callable[[list[str]], np.ndarray] = hashed_embedding, longest: int = 3, top: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, keyword and score of the top n-grams (1 to longest words) of each text by cosine to the text itself, ties by keyword."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ident, body in zip(b[key], b[text], strict=True):
                words = (body or "").lower().split()
                grams = sorted({" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)})
                if not grams:
                    continue
                e = np.asarray(embed([" ".join(words), *grams]), float)
                e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)
                score = e[1:] @ e[0]
                rows += [(ident, grams[k], float(score[k])) for k in np.lexsort((np.arange(len(grams)), -score))[:top]]
            yield pd.DataFrame(rows, columns=[key, "keyword", "score"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, keyword string, score double")


def keyword_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
