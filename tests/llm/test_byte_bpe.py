"""Encoding by recursive queries, against the library of rank files."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tessera.llm import bpe, byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def engine():
    return byte_bpe.Encoder(PATH)


def agree(engine, library, texts):
    rows = engine.encode(texts)
    assert [r.tolist() for r in rows] == [library.encode_ordinary(t) for t in texts]
    assert [b"".join(parts) for parts in engine.decode(rows, most=7)] == [t.encode() for t in texts]


def test_pattern_is_the_public_one():
    assert bpe.PIECES == public_tokenizers.PATTERN


@pytest.mark.parametrize("table", ["awkward", "docs"])
def test_query_is_the_library(table, request, library):
    df = request.getfixturevalue(table)
    out = byte_bpe.encode_decode_ranks(df, PATH, ids=True)
    assert out.count() == df.count()
    for r in out.select("text", "n_tokens", "ids_sha256", "decoded_sha256", "ids").collect():
        want = library.encode_ordinary(r["text"] or "")
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_blanks_and_odd_characters(engine, library):
    agree(engine, library, ["", " ", "a", " a", "  a", "a  b", "\na b\n", " a b ", "x\n y", "'s it's", "a\0b c", "\0", " \0 "])
    agree(engine, library, [f"a{chr(c)} b{chr(c)}1 {chr(c)}{chr(c)} x" for c in [*range(0xD800), *range(0xE000, 0x3400)]])
    rng = random.Random(3)
    parts = ["'re", "don't", "abc", "Ωmega", "é", "각", "12", " ", "  ", "\n", "\t", "!!", "😀", "straße", "<|endoftext|>", "x" * 30, " ", "\x1c", "\x85", "　"]
    agree(engine, library, ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(1000)])


def test_long_words_are_joined_from_windows(engine, library):
    rng = random.Random(4)
    letters = ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(n)) for n in (127, 128, 129, 500, 20_000)]
    agree(engine, library, [*letters, "a" * 50_000, "-" * 5001, " " * 7777 + "x", "\n" * 999, "é" * 3000, "日本語" * 2000, "=" * 1280 + "x"])


def test_windows_without_a_common_token_are_widened(engine, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "WINDOW", 4)
    agree(engine, library, ["internationalisation", "a" * 100, "ab" * 50, "Donaudampfschifffahrtsgesellschaft"])


def test_segments_do_not_change_ids(engine, library):
    rng = random.Random(5)
    text = "".join(rng.choice(["ab", " ", "  ", "c.", "\n", " de"]) for _ in range(400))
    whole = library.encode_ordinary(text)
    for most in (1, 7, 50):
        cut = list(byte_bpe.segments(text, most))
        assert "".join(cut) == text and np.concatenate(engine.encode(cut)).tolist() == whole


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MOST_RUNS", 20)
    monkeypatch.setattr(byte_bpe, "MOST_WORDS", 20)
    small, rng = byte_bpe.Encoder(PATH), random.Random(6)
    for _ in range(20):
        agree(small, library, [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 90))) for _ in range(10))])


def test_empty_table(empty):
    assert byte_bpe.encode_decode_ranks(empty, PATH).count() == 0
