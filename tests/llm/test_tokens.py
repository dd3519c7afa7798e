"""Token counts, BPE and packing against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import ODD, docs, table

from triplewright.llm import best_fit_packing as B
from triplewright.llm import bpe, token_counts
from triplewright.llm.queries import vocabulary
from triplewright.llm.tokenizer_units import Units

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
BITS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", ".", ",", "x.", "1,", "don't", "'s,", "A.\nB", "é,", "é", "a", "the", "12", "　", "\x85", "\x1c", "日本", "x" * 40, "!!!", "<|endoftext|>", " <|endoftext|>", "<|startoftext|>", "İ", "́"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {name: Tokenizer.from_file(vocabulary(name)) for name in (BYTE, WORD)}


def ids(library, name, text):
    return library[name].encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    return ["".join(rng.choices(BITS, k=rng.randint(0, 25))) for _ in range(1500)] + ["a" * 5000, " " * 3000, "ab " * 5000, "é" * 3000, "", " ", "\n", "a ", " a"]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_units_equal_the_library(library, odd, name):
    texts = [t.encode() for t in odd]
    want = [len(ids(library, name, t)) for t in odd]
    units = Units(vocabulary(name), ids=False)
    assert units.encode(texts) == want
    assert units.encode(texts) == want  # from the cache


def test_small_caches_change_nothing(library, odd, monkeypatch):
    monkeypatch.setattr("triplewright.llm.tokenizer_units.CACHE_UNITS", 50)
    units = Units(vocabulary(WORD), ids=False)
    for k in range(0, len(odd), 40):
        assert units.encode([t.encode() for t in odd[k : k + 40]]) == [len(ids(library, WORD, t)) for t in odd[k : k + 40]]


def test_counts_of_a_table(spark, sf, library):
    d = table(spark, sf)
    out = {r.doc_id: r for r in token_counts.token_counts(d, vocabulary(WORD)).collect()}
    for r in d.collect():
        n = len(ids(library, WORD, r.text))
        assert tuple(out[r.doc_id]) == (r.doc_id, len(r.text.encode()), n, n > 2048)
    rows = token_counts.token_counts(docs(spark, ODD).selectExpr("*", "9 AS n_tokens"), vocabulary(WORD)).collect()
    assert sorted(map(str, ((r.doc_id, r.n_tokens) for r in rows))) == sorted(map(str, ((k, len(ids(library, WORD, t))) for k, t in ODD)))
    assert token_counts.token_counts(docs(spark, []), vocabulary(WORD)).count() == 0


def test_backtracking_equals_the_library(library, odd):
    units = bpe.BacktrackingUnits(vocabulary(BYTE))
    got = units.encode([t.encode() for t in odd])
    assert got == [np.asarray(ids(library, BYTE, t), "<u4").tobytes() for t in odd]
    assert [t.decode() for t in units.codec.decode(got)] == [library[BYTE].decode(ids(library, BYTE, t), skip_special_tokens=False) for t in odd]


def test_each_token_encodes_to_itself():
    """With this, equal ids follow for any encoder that merges by rank."""
    codec = bpe.Codec(vocabulary(BYTE))
    for i, raw in codec.bytes_of.items():
        if i not in codec.rank:
            continue
        parts = [codec.token_of[raw[k : k + 1]] for k in range(len(raw))]
        while len(parts) > 1:  # plain merging: the pair of least rank first
            ranks = [codec.rank.get(codec.merged.get(p, -1), 1 << 30) for p in zip(parts, parts[1:], strict=False)]
            k = ranks.index(min(ranks))
            assert ranks[k] < 1 << 30
            parts[k : k + 2] = [codec.merged[parts[k], parts[k + 1]]]
        assert parts == [i]


def test_odd_bytes_decode_as_the_library_does(library):
    codec = bpe.Codec(vocabulary(BYTE))
    rng = random.Random(1)
    for _ in range(300):
        some = [rng.randrange(50257) if rng.random() < 0.3 else rng.randrange(256) for _ in range(rng.randrange(8))]
        assert codec.decode([np.asarray(some, "<u4").tobytes()])[0].decode() == library[BYTE].decode(some, skip_special_tokens=False)


def test_round_trip_of_tables(spark, sf, library):
    for d in (table(spark, sf), docs(spark, ODD).selectExpr("*", "1 AS ids")):
        rows = sorted(map(str, (tuple(r) for r in bpe.encode_decode(d, vocabulary(BYTE)).collect())))
        want = []
        for r in d.collect():
            i = ids(library, BYTE, r.text)
            want.append((r.doc_id, len(i), hashlib.sha256(np.asarray(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert rows == sorted(map(str, want))
    coded = bpe.encode_decode(docs(spark, ODD), vocabulary(BYTE), with_ids=True)
    assert sorted(str((r.doc_id, r.text)) for r in bpe.decode(coded, vocabulary(BYTE)).collect()) == sorted(str((k, t or "")) for k, t in ODD)
    assert bpe.encode_decode(docs(spark, []), vocabulary(BYTE)).count() == 0


def check_packing(rows, texts, library, size=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        i = np.asarray([*ids(library, BYTE, text), 2], "<u4")
        own = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(i) // size)))
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert sum(r.length for r in own) == len(i) and all(r.length == size for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(i[r.start : r.start + r.length].tobytes()) for r in own)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert sum(r.length for r in own) <= size
    return len(by_sequence)


def test_packing_a_table(spark, sf, library):
    d = table(spark, sf)
    rows = B.pack(d, vocabulary(BYTE)).collect()
    n = check_packing(rows, {r.doc_id: r.text for r in d.collect()}, library)
    assert n <= -(-sum(r.length for r in rows) // 1024) * 1.02 + 1


def test_packing_odd_rows(spark, library):
    rows = [r for r in dict(ODD).items() if r[0] is not None]
    check_packing(B.pack(docs(spark, rows).selectExpr("*", "1 AS length", "2 AS rank"), vocabulary(BYTE)).collect(), dict(rows), library)
    assert B.pack(docs(spark, ODD), vocabulary(BYTE)).count() >= len(ODD)
    assert B.pack(docs(spark, []), vocabulary(BYTE)).count() == 0


def test_plans_hold_every_item():
    rng = np.random.default_rng(4)
    for size in (8, 64, 1024):
        counts = np.zeros(size + 1, np.int64)
        np.add.at(counts, rng.integers(1, size + 1, 5000), 1)
        groups, _ = B.plan(counts, size)
        used = np.zeros(size + 1, np.int64)
        for held, bins in groups:
            assert bins > 0 and sum(length * each for length, each in held) <= size
            for length, each in held:
                used[length] += each * bins
        assert (used == counts).all()
        assert sum(g[1] for g in groups) <= sum(g[1] for g in B.pack_rest(counts, size))


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_patterns_carry_the_plan(name):
    import pyarrow.parquet as pq

    from triplewright.llm.byte_level import ByteLevelIds

    units, counts = ByteLevelIds(vocabulary(BYTE)), np.zeros(1025, np.int64)
    texts = [(t or "").encode() for t in pq.read_table(f"/root/testdata/{name}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    for at in range(0, len(texts), 500):
        for ids in units.encode(texts[at : at + 500]):
            n = len(ids) // 4 + 1
            np.add.at(counts, [1024] * ((n - 1) // 1024) + [n - (n - 1) // 1024 * 1024], 1)
    groups, placed = B.plan(counts, 1024)
    assert placed > 0.6 * counts.sum()
    short = counts[:1024].sum()
    assert placed - counts[1024] > 0.4 * short  # without the pieces that fill a sequence alone
    assert sum(g[1] for g in groups) <= 1.005 * -(-int((counts * np.arange(1025)).sum()) // 1024)


def test_patterns_and_fit():
    rows = B.patterns(np.arange(1, 20), 20)
    assert (rows.sum(1) == 20).all() and len({tuple(sorted(r)) for r in rows.tolist()}) == len(rows)
    counts = np.zeros(21)
    counts[[5, 15]] = 7
    assert abs(B.nnls(B.patterns(np.flatnonzero(counts), 20), counts).max() - 7) < 1


def test_other_patterns_go_to_the_library(tmp_path, odd):
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(vocabulary(WORD), encoding="utf-8"))
    for name, change in {
        "lines": lambda s: s["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"[^\n]+"),
        "strip": lambda s: s["normalizer"]["normalizers"].append({"type": "Replace", "pattern": {"String": " "}, "content": "_"}),
        "special": lambda s: s["added_tokens"][0].update(content="<| end |>"),
    }.items():
        other = json.loads(json.dumps(spec))
        change(other)
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(other), encoding="utf-8")
        units = Units(str(path), ids=False)
        assert not units.drops_space and not units.keeps_space
        library = Tokenizer.from_file(str(path))
        assert units.encode([t.encode() for t in odd[:200]]) == [len(library.encode(t, add_special_tokens=False).ids) for t in odd[:200]]
