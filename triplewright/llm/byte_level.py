"""Token ids of byte-level BPE files, as the tokenizers library gives them, at the speed of tiktoken.

Both libraries cut a text by the same pattern and merge the pair of least rank first. tiktoken merges any two tokens
whose bytes together are a token; tokenizers only listed pairs. Results are equal wherever each token's own bytes
encode to that token: two neighbours that span a token's bytes arose as they would from these bytes alone, so the pair
is the listed one. Files for which ids do not follow the order of merges go to the tokenizers library.
"""

from __future__ import annotations

import json
import os

import numpy as np

LONG_TEXT = 1 << 20
# Fixed value: the split pattern of byte-level vocabularies of this family.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevelIds:
    """Ids of whole texts as bytes of little-endian unsigned 32-bit integers; special strings become their ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.open = lambda: Tokenizer.from_file(path)
        self.tokenizer = None
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        letters = byte_letters()
        self.fast = None
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        if plain and not model.get("ignore_merges") and not model.get("dropout"):
            ids = model["vocab"]
            made = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
            if all(a < b for a, b in zip(made, made[1:], strict=False)) and len(made) + 256 == len(ids):
                ranks = {bytes(letters[c] for c in token): i for token, i in ids.items()}
                self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})

    def library(self, text: str) -> list[int]:
        """Ids by the tokenizers library, which is opened when first needed."""
        if self.tokenizer is None:
            self.tokenizer = self.open()
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out = []
        for text in texts:
            plain = text.decode("utf-8", "replace")
            if self.fast and len(text) <= LONG_TEXT:
                out.append(self.fast.encode_to_numpy(plain, allowed_special="all").astype("<u4", copy=False).tobytes())
            else:
                out.append(np.asarray(self.library(plain), "<u4").tobytes())
        return out
