"""Quality scores by logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, tidy
from .tokenizer_units import segments

BITS = 18
SAMPLE = 8_192  # labelled documents that a model is fitted on, at most
EPOCHS = 3
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n")
TOKEN_CACHE = 150_000
_MASK = np.uint64((1 << BITS) - 1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def shape(token: str) -> int:
    """Form of a token: line end, letters by case, digits, sentence marks, one repeated mark, other marks."""
    if token == "\n":
        return 1
    if token[0].isalpha():
        if token.islower():
            return 2 + (len(token) > 3) + (len(token) > 12)
        if token.isupper():
            return 5 + (len(token) > 1)
        return 7 if token[1:].islower() else 8
    if token[0].isdigit():
        return 9
    if token in (".", ",", ";", ":", "?", "'", "-", "(", ")", '"'):
        return 10
    if len(set(token)) == 1:
        return 11 if len(token) > 1 else 12
    return 13 if len(token) < 4 else 14


class _Tokens(dict):
    """Hash of a token, its form in the lowest four bits."""

    def __missing__(self, token: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > TOKEN_CACHE:
            self.clear()
        found = self[token] = (xxh64_intdigest(token) & ~15) | shape(token)
        return found


_tokens = _Tokens()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _MULT
    return x ^ (x >> np.uint64(29))


def _count(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of one stream: indices and log counts of Euclidean length 1."""
    index, n = np.unique(np.concatenate([(_mix(p) >> np.uint64(40)) & _MASK for p in parts]), return_counts=True)
    value = np.log1p(n)
    return index, value / np.sqrt((value * value).sum())


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices (distinct, ascending) and values of the n-grams of words (1 and 2) and of word forms (1 to 3)."""
    pieces = [np.fromiter(map(_tokens.__getitem__, TOKEN.findall(s.decode("utf-8", "replace"))), np.uint64) for s in segments(text)]
    h = pieces[0] if len(pieces) == 1 else np.concatenate(pieces)
    if not len(h):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    words, form = h >> np.uint64(4), (h & np.uint64(15)) + np.uint64(1)
    surface = _count([words, words[:-1] * np.uint64(31) + words[1:]])
    two = form[:-1] * np.uint64(16) + form[1:]
    forms = _count([form, two + np.uint64(1 << 10), two[:-1] * np.uint64(16) + form[2:] + np.uint64(1 << 20)])
    index, place = np.unique(np.concatenate([surface[0], forms[0]]), return_inverse=True)
    value = np.bincount(place, np.concatenate([surface[1], 3 * forms[1]]))
    return index.astype(np.int32), value.astype(np.float32)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after per-coordinate FTRL-proximal updates; the last one is the bias. No examples give zeros."""
    size = (1 << BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            index, value, label = examples[k]
            at = np.append(index, size - 1)
            x = np.append(value, 1.0)
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(wi @ x, -35, 35))) - label) * x
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wi
            n[at] += g * g
    live = np.abs(z) > l1
    w[live] = -(z[live] - np.sign(z[live]) * l1) / ((beta + np.sqrt(n[live])) / alpha + l2)
    return w


def probability(weights: np.ndarray, text: bytes) -> float:
    index, value = features(text)
    return float(1 / (1 + np.exp(-np.clip(weights[index] @ value + weights[-1], -35, 35))))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), batch.column("key"), batch.column("label"), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], ["doc_id", "key", "label", "at", "x"])


def _fit(table: pa.Table) -> pa.Table:
    table = table.sort_by([("key", "ascending"), ("label", "ascending")])
    examples = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32), y) for y, a, x in zip(*(table.column(c).to_pylist() for c in ("label", "at", "x")), strict=True)]
    return pa.table({"weights": pa.array([ftrl(examples).astype(np.float32).tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Weights fitted on labelled documents: the sample (at most) of least hash, the same for any partitioning.

    labels: id_col and label (0 or 1); rows with nulls are left out. The sample bounds what is broadcast and, with one
    text an id where ids are repeated, what one task fits; only the weights reach the driver. Without labelled documents
    all weights are 0, and scores 0.5.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.select("doc_id", row_key("doc_id", "text").alias("key"), "text", "label").mapInArrow(_featurise, f"doc_id {kind}, key bigint, label int, at binary, x binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("key", "label", "at", "x")).alias("r")).select("r.*")
    fitted = rows.groupBy(F.lit(0).alias("model")).applyInArrow(lambda t: _fit(t), "weights binary").collect()
    return np.frombuffer(fitted[0][0], np.float32) if fitted else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1; higher: label 1 is likelier) of each row, from its whole text only.

    Null and empty texts score what the bias alone gives. Repeated rows and null ids are kept; an empty table gives an
    empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([probability(w, t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(id_col, text_col).mapInArrow(scored, f"doc_id {kind}, score double")


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4: such rows never train."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of each row, trained on rows not held out."""
    weights = train(docs, labels.filter(~held_out(id_col)), id_col=id_col, text_col=text_col)
    found = score(docs, weights, id_col, text_col)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that score threshold or more. Without labelled documents nothing is rejected."""
    weights = train(docs, labels.filter(~held_out(id_col)), id_col=id_col, text_col=text_col)
    if not weights.any():
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([probability(shared.value, t or b"") >= threshold for t in batch.column(at).cast(pa.binary()).to_pylist()], pa.bool_()))
        tidy()

    return docs.mapInArrow(kept, docs.schema)
