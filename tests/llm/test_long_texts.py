"""Texts of more than a million bytes, which some operators cut or hand on, against the same brute force as short ones."""

import random

import pytest
import test_quality_rules
import test_simhash_dedup
import test_substring_dedup
import test_tokens
from helpers import docs
from test_tokens import BYTE, WORD, ids, library  # noqa: F401

from triplewright.llm import best_fit_packing, bpe, license_scan, quality_rules, simhash_dedup, substring_dedup, token_counts
from triplewright.llm.queries import vocabulary


def prose(seed, n=210_000):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(2, 9))) for _ in range(4000)] + ["don't", "\u00e9t\u00e9", "x.", "1999,", "A"]
    return "".join(w + rng.choice([" "] * 30 + [". ", "\n", "  ", ",\n\n"]) for w in rng.choices(words, k=n))


@pytest.fixture(scope="module")
def rows():
    first = prose(1)
    return [(1, first), (2, "Own start. " + first[:700_000] + " own middle " + first[700_000:] + "\nReleased under the MIT License.\n"), (3, "ab" * 600_000), (4, "short text")]


def test_sizes(rows):
    assert all(len(t.encode()) > 1 << 20 for _, t in rows[:3])


def test_license(spark, rows):
    out = license_scan.license_scan(docs(spark, rows)).collect()
    assert [(r.doc_id, r.unit, r.license) for r in out] == [(2, "line", "mit")]


def test_tokenizers(spark, rows, library):  # noqa: F811
    import hashlib

    import numpy as np

    for r in bpe.encode_decode(docs(spark, rows), vocabulary(BYTE)).collect():
        text = dict(rows)[r.doc_id]
        want = ids(library, BYTE, text)
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.asarray(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    for r in token_counts.token_counts(docs(spark, rows), vocabulary(WORD)).collect():
        assert r.n_tokens == len(ids(library, WORD, dict(rows)[r.doc_id]))
    test_tokens.check_packing(best_fit_packing.pack(docs(spark, rows), vocabulary(BYTE)).collect(), dict(rows), library)


def test_fingerprints(spark, rows):
    assert test_simhash_dedup.got(simhash_dedup.near_duplicates(docs(spark, rows))) == test_simhash_dedup.brute(rows)


def test_passages(spark, rows):
    assert test_substring_dedup.got(substring_dedup.removal_digest(docs(spark, rows))) == test_substring_dedup.brute(rows)


def test_rules(spark, rows):
    out = {r[0]: tuple(r)[1:7] for r in quality_rules.quality_rules(docs(spark, rows)).collect()}
    assert out == {k: test_quality_rules.brute(t) for k, t in rows}
