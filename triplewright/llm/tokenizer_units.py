"""Exact tokenizer output from distinct text units.

A text is cut where no token can span the cut: at ASCII white space for vocabularies that drop white space, and
before a single space between two words for byte-level vocabularies that keep it. Each distinct unit is then encoded
once by the library and looked up afterwards. Texts whose cuts are not provably safe (runs of white space next to a
space, special strings) go to the library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np

CACHE_UNITS = 600_000
CACHE_PIECES = 200_000
# Closing marks: no vocabulary joins them to a letter or digit before them.
MARKS = b".,;:!?"
LONG_UNIT = 512
# All white space of Unicode and the separators that str.isspace adds, in UTF-8.
SPACES = tuple(chr(c).encode() for c in range(0x3001) if chr(c).isspace())
BATCH_BYTES = 128 << 10
SEGMENT_BYTES = 1 << 20


def by_bytes(units: list[bytes], most: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    """Consecutive batches of about equal bytes; a longer unit stands alone."""
    batch, size = [], 0
    for unit in units:
        if batch and size + len(unit) > most:
            yield batch
            batch, size = [], 0
        batch.append(unit)
        size += len(unit)
    if batch:
        yield batch


def segments(text: bytes, most: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """Slices of about most bytes that end before an ASCII space; a text without spaces stays whole."""
    at = 0
    while len(text) - at > most:
        cut = text.find(b" ", at + most)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


# The split pattern and normalisers of word-level vocabularies for which cuts at ASCII white space are proved:
# no match of the pattern holds white space or depends on any beside it, nor does a normaliser join what it parts.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


class Units:
    """Token ids (as bytes of little-endian unsigned 32-bit integers) or token numbers of whole texts."""

    def __init__(self, path: str, ids: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ids = ids
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        pre = spec.get("pre_tokenizer") or {}
        first = (pre.get("pretokenizers") or [pre])[0]
        normalizer = spec.get("normalizer")
        steps = (normalizer or {}).get("normalizers", [normalizer] if normalizer else [])
        tight = not any(c.isspace() for t in spec["added_tokens"] for c in t["content"])
        self.drops_space = tight and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and first.get("pattern") == {"Regex": WORD_SPLIT} and all(x in WORD_NORMALIZERS for x in steps)
        self.keeps_space = tight and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not normalizer
        self.cache: dict[bytes, object] = {}
        self.pieces: dict[bytes, object] = {}

    def library(self, texts: list[bytes]) -> list:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() if self.ids else len(e) for e in found]

    def joined(self, units: list[bytes]) -> list:
        """As library(), for many short units: one text in which a special string, which no token spans, parts them."""
        if not self.special or any(s in u for s in self.special for u in units):
            return self.library(units)
        mark, number = self.special[-1], self.tokenizer.token_to_id(self.special[-1].decode())
        found = self.tokenizer.encode_batch_fast([mark.join(units).decode("utf-8", "replace")], add_special_tokens=False)[0]
        ids = np.asarray(found.ids, "<u4")
        at = np.flatnonzero(ids == number)
        ends = np.append(at, len(ids))
        starts = np.concatenate([[0], at + 1])
        if not self.ids:
            return (ends - starts).tolist()
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def whole(self, text: bytes):
        return self.library([text])[0]

    def unsafe(self, unit: bytes, last: bool = False) -> bool:
        """Whether a cut beside this unit (without its leading space) touches other white space."""
        if not unit:
            return True
        first, end = unit[0], unit[-1]
        return ((first < 33 or first > 126) and unit.startswith(SPACES)) or (not last and (end < 33 or end > 126) and unit.endswith(SPACES))

    def pieces_of(self, unit: bytes, lead: bytes) -> list[bytes]:
        """A unit at borders that no token spans: around single line ends, and between a letter or digit and closing marks."""
        out: list[bytes] = []
        lines = unit.split(b"\n") if lead else [unit]
        if len(lines) > 1 and any(self.unsafe(line) for line in lines):
            return [unit]
        for k, line in enumerate(lines):
            if k:
                out.append(b"\n")
            stem = line.rstrip(MARKS)
            if stem and len(stem) < len(line) and stem[-1:].isalnum():
                out += [stem, line[len(stem) :]]
            else:
                out.append(line)
        return out

    def learn(self, units: set[bytes], lead: bytes) -> dict[bytes, object]:
        """Encode units that the cache lacks; values of long ones are returned only, so that the cache stays small."""
        if len(self.cache) > CACHE_UNITS:
            self.cache.clear()
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        cache, pieces = self.cache, self.pieces
        once: dict[bytes, object] = {}
        rest: dict[bytes, object] = {}
        new, cut, inner = set(), {}, set()
        for unit in units:
            if lead and self.unsafe(unit):
                continue
            if unit[-1] in MARKS or b"\n" in unit:
                cut[unit] = first, *more = self.pieces_of(unit, lead)
                if first not in cache:
                    new.add(first)
                inner.update(more)
            else:
                new.add(unit)
        for found, store, spare, front in ((new, cache, once, lead), (inner.difference(pieces), pieces, rest, b"")):
            for batch in by_bytes(list(found)):
                for unit, value in zip(batch, self.joined([front + u for u in batch] if front else batch), strict=True):
                    (spare if len(unit) > LONG_UNIT else store)[unit] = value
        for unit, (first, *more) in cut.items():
            if more:
                value = cache[first] if first in cache else once[first]
                others = [pieces[p] if p in pieces else rest[p] for p in more]
                (once if len(unit) > LONG_UNIT else cache)[unit] = b"".join([value, *others]) if self.ids else value + sum(others)
        return once

    def known(self, cut: list[list[bytes]], lead: bytes) -> list[list]:
        """Values of lists of units; None stands for a unit that is not safe."""
        get = self.cache.get
        values = [list(map(get, words)) for words in cut]
        lacking = [k for k, v in enumerate(values) if None in v]
        if lacking:
            once = self.learn({u for k in lacking for u, v in zip(cut[k], values[k], strict=True) if v is None}, lead)
            for k in lacking:
                values[k] = [once.get(u, get(u)) if v is None else v for u, v in zip(cut[k], values[k], strict=True)]
        return values

    def encode(self, texts: list[bytes]) -> list:
        """One value a text, in order: ids as bytes, or the number of tokens."""
        if not (self.drops_space or self.keeps_space):
            return [v for batch in by_bytes(texts) for v in self.library(batch)]
        out: list = []
        for batch in by_bytes(texts, 4 * SEGMENT_BYTES):
            out += self.dropped(batch) if self.drops_space else self.kept(batch)
        return out

    def total(self, values: list):
        return b"".join(values) if self.ids else sum(values)

    def dropped(self, texts: list[bytes]) -> list:
        if len(texts) == 1:
            return [self.total([self.total(self.known([s.split()], b"")[0]) for s in segments(texts[0])])]
        return [self.total(v) for v in self.known([t.split() for t in texts], b"")]

    def kept(self, texts: list[bytes]) -> list:
        cut = [[] if any(s in t for s in self.special) else t.split(b" ") for t in texts]
        middle = self.known([words[1:-1] for words in cut], b" ")
        out: list = [b"" if self.ids else 0] * len(texts)
        later, ends = [], []
        for k, words in enumerate(cut):
            if not texts[k]:
                continue
            if len(words) < 3 or self.unsafe(words[0]) or self.unsafe(words[-1], last=True):
                out[k] = self.whole(texts[k])
                continue
            if None in middle[k]:  # a cut beside more white space
                out[k] = self.whole(texts[k])
                continue
            out[k] = self.total(middle[k])
            later.append(k)
            ends += [words[0], b" " + words[-1]]
        found = self.library(ends) if ends else []
        for k, first, last in zip(later, found[::2], found[1::2], strict=True):
            out[k] = first + out[k] + last
        return out
