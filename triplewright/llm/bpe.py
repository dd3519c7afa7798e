"""Byte-pair encoding by backtracking over Aho-Corasick matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_level import SPLIT, byte_letters
from .tokenizer_units import LONG_UNIT, Units, by_bytes

PAIR_CACHE = 1_000_000
PIECE_CACHE = 20_000


class Codec:
    """Vocabulary, matcher and pair table of one tokenizer file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {ids[t]: b for t, b in raw.items()} | {i: b for b, i in self.special.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank = {i: -1 for i in ids.values()}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            made = ids[left + right]
            self.merged[ids[left], ids[right]] = made
            if made not in self.parts:
                self.parts[made] = ids[left], ids[right]
                self.rank[made] = rank
        self.matcher = ahocorasick.Automaton()
        for token, i in ids.items():
            self.matcher.add_word(raw[token].decode("latin-1"), (i, len(raw[token])))
        self.matcher.make_automaton()
        of = self.token_of = {b: i for i, b in self.bytes_of.items() if i in self.rank}
        self.shorter = {i: next((of[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in of), None) for b, i in of.items()}
        top = max(self.bytes_of) + 1
        self.offsets = np.zeros(top + 1, np.int64)
        self.offsets[1:] = np.cumsum([len(self.bytes_of.get(i, b"")) for i in range(top)])
        self.blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(top)), np.uint8)
        self.sizes = [len(self.bytes_of.get(i, b"")) for i in range(top)]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.pattern = regex.compile(SPLIT)
        self.cut_special = regex.compile("(" + "|".join(regex.escape(s.decode()) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens would leave exactly these two.

        The tokens are taken apart in reverse merge order; they fail if some pair that meets at the border would have
        merged before the tokens themselves were made.
        """
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > PAIR_CACHE:
                self.pairs.clear()
            found = self.pairs[left, right] = self._compatible(left, right)
        return found

    def _compatible(self, left: int, right: int) -> bool:
        before = len(self.merged) + 1, True  # a pair at the border must not merge before this
        while True:
            made = self.merged.get((left, right))
            if made is not None:
                rank = self.rank[made]
                if rank < before[0] or (rank == before[0] and not before[1]):
                    return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:  # the left token was made last; equal ranks merge from the left
                before = a, True
                left = self.parts[left][1]
            else:
                before = b, False
                right = self.parts[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.token_of.get(piece)
        if whole is not None:
            return [whole]
        best: list[int] = [0] * len(piece)
        for end, (token, n) in self.matcher.iter(piece.decode("latin-1")):
            best[end - n + 1] = token  # later ends are longer
        open_at = bytearray(b"\x01" * (len(piece) + 1))
        size, shorter, pairs = self.sizes, self.shorter, self.pairs
        out: list[int] = []
        at, token = 0, best[0] if best else None
        while at < len(piece):
            last = out[-1] if out else None
            while token is not None:
                end = at + size[token]
                if open_at[end]:
                    if last is None:
                        break
                    fits = pairs.get((last, token))
                    if fits or (fits is None and self.compatible(last, token)):
                        break
                token = shorter[token]
            if token is not None:
                out.append(token)
                at = end
                if at < len(piece):
                    token = best[at]
            else:  # nothing fits from here: never end a token here again
                open_at[at] = 0
                token = out.pop()
                at -= size[token]
        return out

    def encode_plain(self, text: str) -> list[int]:
        if text.isalpha() or (text[:1] == " " and text[1:].isalpha()):
            return self.encode_piece(text.encode())  # one pre-token
        known = self.pieces
        out: list[int] = []
        for piece in self.pattern.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode())
                if len(piece) <= LONG_UNIT:
                    if len(known) > PIECE_CACHE:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def encode_text(self, text: bytes) -> bytes:
        """Ids of any text, special strings included, as bytes of unsigned 32-bit integers."""
        decoded = text.decode("utf-8", "replace")
        out: list[int] = []
        for part in self.cut_special.split(decoded) if self.cut_special else [decoded]:
            special = self.special.get(part.encode())
            out += [special] if special is not None else self.encode_plain(part)
        return np.asarray(out, "<u4").tobytes()

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Texts of id arrays: all bytes are gathered from the table at once; malformed UTF-8 becomes U+FFFD."""
        tokens = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        starts = self.offsets[tokens]
        sizes = self.offsets[tokens + 1] - starts
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.blob[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        cuts = ends[np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids])]).astype(np.int64)]
        parts = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return [p.decode("utf-8", "replace").encode() for p in parts]


class BacktrackingUnits(Units):
    """Text units whose ids come from the backtracking encoder instead of the library."""

    def __init__(self, path: str):
        super().__init__(path, ids=True)
        self.codec = Codec(path)

    def library(self, texts: list[bytes]) -> list[bytes]:
        return [self.codec.encode_text(t) for t in texts]

    def joined(self, units: list[bytes]) -> list[bytes]:
        """As library(), for units without special strings."""
        plain = self.codec.encode_plain
        return [b"".join([i.to_bytes(4, "little") for i in plain(u.decode("utf-8", "replace"))]) for u in units]


_open: dict[str, BacktrackingUnits] = {}


def _round_trip(path: str, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    units = _open.get(path) or _open.setdefault(path, BacktrackingUnits(path))
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        n, coded, decoded, at = [], [], [], 0
        kept: list[bytes] = []
        for group in by_bytes(texts, 2 << 20):
            ids = units.encode(group)
            n += [len(x) // 4 for x in ids]
            coded += [hashlib.sha256(x).hexdigest() for x in ids]
            decoded += [hashlib.sha256(x).hexdigest() for x in units.codec.decode(ids)]
            kept += ids if with_ids else []
            at += len(group)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in kept], pa.list_(pa.int32())))
            names.append("ids")
        yield pa.record_batch(columns, names)


def encode_decode(docs: DataFrame, tokenizer: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and the ids themselves if with_ids.

    tokenizer: path of a byte-level BPE file of the tokenizers library; ids equal that library's without added special
    tokens. Each pre-token takes the longest vocabulary match at its start and backs off to shorter prefixes until the
    pair with the token before it is compatible, which gives the exact merges in time linear in its length. Ids are
    decoded again by an offset table over the vocabulary's bytes.
    Null and empty texts have no ids. Repeated rows and null ids are kept. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(partial(_round_trip, tokenizer, with_ids), schema)


def _decode(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    units = _open.get(path) or _open.setdefault(path, BacktrackingUnits(path))
    for batch in batches:
        ids = [np.asarray(x or [], "<u4").tobytes() for x in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array([t.decode() for t in units.codec.decode(ids)], pa.string())], ["doc_id", "text"])


def decode(rows: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of token ids; null ids give an empty text."""
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, ids_col).mapInArrow(partial(_decode, tokenizer), f"doc_id {kind}, text string")
