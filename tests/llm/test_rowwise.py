"""Operators that work row by row, against plain Python or the library that they stand for."""

import hashlib
import random
import re
import struct
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import bpe, licenses, media, quality, queries, token_count


def by_text(df, *columns):
    return [(r["text"] or "", *[r[c] for c in columns]) for r in df.select("text", *columns).collect()]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain_quality(text):
    words = words_of(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n


@pytest.mark.parametrize("table", ["awkward", "docs"])
def test_quality_counts(table, request):
    df = request.getfixturevalue(table)
    out = quality.repetition_quality(df)
    assert out.count() == df.count()
    for text, *got in by_text(out, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"):
        assert tuple(got) == plain_quality(text)
    assert {r.kept for r in out.filter("base_failed").select("kept").collect()} <= {False}


def plain_share(text, n):
    words, seen, inside = words_of(text), set(), set()
    for i in range(len(words) - n + 1):
        gram = tuple(words[i : i + n])
        if gram in seen:
            inside |= set(range(i, i + n))
        seen.add(gram)
    return sum(len(words[i]) for i in inside) / max(1, sum(map(len, words)))


def test_quality_shares(awkward):
    for text, shares in by_text(quality.repetition_quality(awkward), "dup_ngram_shares"):
        assert shares == pytest.approx([plain_share(text, n) for n in range(5, 11)])


def test_equal_hashes_are_verified():
    ids = np.array([1, 2, 3, 1, 2, 3, 4, 1, 2])
    plain = [tuple(ids[i : i + 2]) for i in range(8)]
    any_other, later = quality.repeats(np.zeros(8, np.uint64), ids, 2)
    assert any_other.tolist() == [plain.count(x) > 1 for x in plain] and later.tolist() == [x in plain[:i] for i, x in enumerate(plain)]


def test_quality_keeps_clean_and_rejects_repeats(docs):
    clean = b"every word of this short text is its own and no line of it comes back"
    assert quality.judge(clean, quality.Limits())[-1]
    assert not quality.judge(b"a line that comes back with enough words\n" * 4 + clean, quality.Limits())[-1]
    assert quality.keep_quality(docs).columns == docs.columns


def test_png_round_trip_and_features(awkward):
    out = media.read_media(media.store_bytes(awkward))
    assert out.count() == awkward.count()
    features = {}
    for text, n, padded, sha, crc, size, file_sha, feature, file in by_text(out, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"):
        data = text.encode()
        payload = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        assert (n, padded, sha, crc) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-576:]))
        assert (size, file_sha) == (len(file), hashlib.sha256(file).hexdigest())
        assert features.setdefault(text, feature) == feature and len(feature) == 16


def test_media_query_by_its_contract(spark, awkward, tmp_path):
    """The query's tail is that of the last 32 payload bytes, whatever unit the operator uses by itself."""
    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in queries.op2_media(spark, str(tmp_path)).collect()]
    want = []
    for r in awkward.select("doc_id", "text").collect():
        data = (r.text or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        want.append((r.doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_stored_lines_are_filtered(awkward):
    """The filter of each stored line is the one with the least absolute sum, and undoing it gives the bytes back."""
    kinds = set()
    for text, file in by_text(media.store_bytes(awkward), "media"):
        rows = np.frombuffer(zlib.decompress(b"".join(body for kind, body in media.png_chunks(file) if kind == b"IDAT")), np.uint8).reshape(-1, 577)
        kinds |= set(rows[:, 0].tolist())
        plain = np.frombuffer(media.pad(text.encode()), np.uint8).reshape(-1, 576).astype(int)
        assert (media.png_decode(file) == plain).all()
        above = np.vstack([np.zeros((1, 576), int), plain[:-1]])
        left, corner = (np.hstack([np.zeros((len(plain), 1), int), x[:, :-1]]) for x in (plain, above))
        p = left + above - corner
        pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
        nearest = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
        sums = [np.minimum((plain - x) % 256, (x - plain) % 256).sum(axis=1) for x in (0 * plain, left, above, (left + above) // 2, nearest)]
        assert (rows[:, 0] == np.argmin(sums, axis=0)).all()
    assert len(kinds) > 1 and kinds - {0}


def test_many_images_of_all_filters():
    """Bands, widths and types mixed in one call, against the writer's lines."""
    rng = np.random.default_rng(6)
    images = [np.cumsum(rng.integers(0, 9, (h, w)), axis=1).astype(np.uint8) for h, w in ((1, 5), (40, 7), (7, 5), (0, 5), (130, 7), (1, 1))]
    rows = []
    for x in images:
        kinds = rng.integers(0, 5, len(x))
        rows.append(np.vstack([media.filtered(x, k)[i : i + 1] for i, k in enumerate(kinds)]) if len(x) else np.empty((0, 6), np.uint8))
    for band, most in ((512, 1 << 20), (16, 1 << 20), (3, 100)):
        assert all((a == b).all() for a, b in zip(media.unfilter(rows, band, most), images, strict=True))
    tall = rng.integers(0, 256, (50, 9), np.uint8)
    assert (media.png_decode(media.png_encode(tall, band=8)) == tall).all()
    with pytest.raises(ValueError):
        media.unfilter([np.full((2, 4), 5, np.uint8)])


def test_png_filters_and_checksums():
    pixels = np.random.default_rng(1).integers(0, 256, (6, 30), np.uint8)
    for kind in (0, 1, 2, 3, 4, None):
        assert (media.png_decode(media.png_encode(pixels, kind)) == pixels).all()
    # average and Paeth lines, written by the plain definition, with 3 channels
    lines, up = [], [0] * 30
    for y, row in enumerate(pixels.tolist()):
        coded = []
        for i, x in enumerate(row):
            a, b, c = (row[i - 3] if i >= 3 else 0), up[i], (up[i - 3] if i >= 3 else 0)
            p = a + b - c
            guess = (a + b) // 2 if y % 2 else min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            coded.append((x - guess) % 256)
        lines.append(bytes([3 if y % 2 else 4, *coded]))
        up = row
    head = struct.pack(">IIBBBBB", 10, 6, 8, 2, 0, 0, 0)
    file = media.SIGNATURE + media.chunk(b"IHDR", head) + media.chunk(b"IDAT", zlib.compress(b"".join(lines))) + media.chunk(b"IEND", b"")
    assert (media.png_decode(file).reshape(6, 30) == pixels).all()
    broken = bytearray(file)
    broken[60] ^= 1
    with pytest.raises(ValueError):
        media.png_decode(bytes(broken))
    with pytest.raises(ValueError):
        media.png_decode(file[:-12])


def test_cosine_hash_bears_small_changes():
    rng = np.random.default_rng(2)
    image = np.cumsum(rng.normal(size=(64, 576)), axis=1)
    image = ((image - image.min()) / np.ptp(image) * 200 + 20).astype(np.uint8)
    a, b, c = (int(media.cosine_hash(x), 16) for x in (image, image + rng.integers(0, 4, image.shape).astype(np.uint8), image[:, ::-1].copy()))
    assert (a ^ b).bit_count() <= 4 < (a ^ c).bit_count()


def plain_base(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    starts, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("table", ["awkward", "docs"])
def test_license_base(table, request):
    out = licenses.license_scan(request.getfixturevalue(table))
    for text, *got in by_text(out, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"):
        assert tuple(got[:5]) == plain_base(text)
        assert set(got[4].split(",")) - {""} <= set(got[5].split(","))
        assert 0 <= got[6] <= 1


def test_license_fuzzy():
    text = b"Foo. Released undr the MIT licence\nbar, All rights reservd. baz"
    *_, base, labels, score, spans = licenses.scan(text)
    assert base == "" and labels == "all-rights-reserved,mit" and 0.9 < score < 1
    assert [(s["label"], s["first_word"], s["last_word"], s["edits"]) for s in spans] == [("mit", 1, 5, 2), ("all-rights-reserved", 7, 9, 1)]
    # every notice with its allowed edits is found, wherever they fall
    rng = random.Random(4)
    for notice in licenses.notices():
        for _ in range(20):
            chars = list(notice.text)
            for _ in range(notice.edits):
                chars[rng.randrange(len(chars))] = rng.choice("abcz")
            found = licenses.fuzzy_matches("xx " + "".join(chars) + " yy")
            assert any(f[0].label == notice.label for f in found)
    assert licenses.fuzzy_matches("nothing of the kind stands in here") == []


def test_license_time_is_linear_in_matches():
    """100,000 phrases and as many notices with an edit each: seconds, where a search of the rest at each would take hours."""
    began = time.time()
    n = 100_000
    *counts, spans = licenses.scan(b"under the mit license; all rigts reserved. " * n)
    assert counts[:4] == [7 * n, n, 0, 7 * (n - 1)] and counts[4:6] == ["mit", "all-rights-reserved,mit"]
    own = [(x["first_word"], x["last_word"]) for x in spans if x["label"] == "all-rights-reserved"]
    assert own == [(7 * i + 4, 7 * i + 6) for i in range(n)] and time.time() - began < 120


@pytest.mark.parametrize("table", ["awkward", "docs"])
def test_bpe_is_the_library(table, request):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    df = request.getfixturevalue(table)
    out = bpe.encode_decode(df, path, ids=True)
    assert out.count() == df.count()
    for text, n, ids_sha, sha, ids in by_text(out, "n_tokens", "ids_sha256", "decoded_sha256", "ids"):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want and n == len(want)
        assert ids_sha == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert sha == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("table", ["awkward", "docs"])
def test_token_counts_are_the_library_s(table, request):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = token_count.token_counts(request.getfixturevalue(table), path, limit=100)
    for text, size, n, over in by_text(out, "n_bytes", "n_tokens", "over_limit"):
        assert (size, n, over) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids), n > 100)


def odd_texts():
    rng = random.Random(9)
    parts = ["'re", "'r", "'l", "'ll", "''", "'s", "don't", "abc", "Ωmega", "É", "e\u0301", "\u0301", "\u1112\u1161\u11ab", "각", "12", " ", "\n", "!!", "—", "😀", "it's", "straße", "İ", "Σ", "<|startoftext|>", "x" * 30]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(300)]


def test_chunks_do_not_change_counts():
    path = public_tokenizers.path("word_bpe_49k.json")
    counter, library = token_count.counter(path), Tokenizer.from_file(path)
    for text in odd_texts():
        want = len(library.encode(text, add_special_tokens=False).ids)
        for size, block, back in ((1, 3, 1), (2, 2, 4), (7, 32, 3), (40, 4, 256), (1 << 15, 32, 256)):
            assert counter.count(text.encode(), size, block, back) == want, (text, size)


def test_chunk_maps_compose_associatively():
    counter = token_count.counter(public_tokenizers.path("word_bpe_49k.json"))
    chunks = list(token_count.chunks("It's a  test,\nof some-thing LONGER 123 !!'s than one chunk".encode(), 5, 0))
    state, maps = token_count.START, []
    for c in chunks:
        maps.append(counter.chunk_map(c, {state, token_count.START}))
        state = maps[-1][state][0]
    for a, b, c in zip(maps, maps[1:], maps[2:]):
        left, right = token_count.compose(token_count.compose(a, b), c), token_count.compose(a, token_count.compose(b, c))
        assert left == right
    assert token_count.scan(maps)[-1][token_count.START][0] == state


def test_token_counts_of_one_long_line():
    """Text without any blank, in memory that does not grow with it."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library, counter = Tokenizer.from_file(path), token_count.counter(path)
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    text = "".join(rng.choice(words) for _ in range(60_000))
    tracemalloc.start()
    counter.machine.clear()
    got = counter.count(text[:100_000].encode())
    first = tracemalloc.get_traced_memory()[1]
    whole = counter.count(text.encode())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == len(library.encode(text[:100_000], add_special_tokens=False).ids)
    assert whole == len(library.encode(text, add_special_tokens=False).ids)
    assert most < first + 150 * 2**20


def test_empty_tables(empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for out in (quality.repetition_quality(empty), media.read_media(media.store_bytes(empty)), licenses.license_scan(empty), bpe.encode_decode(empty, path), token_count.token_counts(empty, public_tokenizers.path("word_bpe_49k.json"))):
        assert out.count() == 0
