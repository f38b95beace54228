"""Alignment of two tokenizers, against both libraries and plain loops."""

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import alignment, common
from tessera.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        with open(A, encoding="utf-8") as f:
            self.of_a = {i: bytes(letters[c] for c in t) for t, i in json.load(f)["model"]["vocab"].items() if t != "<|endoftext|>"}

    def of_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        whole, sides = (" " + text).encode(), []
        for ids, of in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.of_a.get), (self.b.encode(text), self.of_b)):
            at, row = 0, []
            for i in ids:
                at += len(of(i))
                row.append((at, i))
            if b"".join(map(of, ids)) != whole:
                return []
            sides.append(row)
        common, out, group = {e for e, _ in sides[0]} & {e for e, _ in sides[1]}, [], {}
        for end, side, i in sorted((e, n, i) for n, side in enumerate(sides) for e, i in side):
            group.setdefault(side, []).append(i)
            if end in common and side == 1:
                out.append((group[0], group[1]))
                group = {}
        return out

    def results(self, texts):
        found = [self.groups(t) for t in texts]
        counts = Counter(p for g in found for p in {(x, y) for a, b in g for x in a for y in b})
        most = Counter()
        for (x, _), n in counts.items():
            most[x] = max(most[x], n)
        out = []
        for g in found:
            links = [(x, y) for a, b in g for x in a for y in b]
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            out.append((
                sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), hashlib.sha256(text.encode()).hexdigest() if g else "",
                sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
            ))
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.mark.parametrize("most", [200_000, 500, 0])
@pytest.mark.parametrize("table", ["awkward", "docs"])
def test_against_plain_loops(table, most, request, plain):
    """All pairs broadcast, only some, or none."""
    df = request.getfixturevalue(table)
    rows = alignment.scored_alignments(df, A, B, most_broadcast=most).collect()
    assert len(rows) == df.count()
    got = Counter((r["text"], *[r[c] for c in COLUMNS]) for r in rows)
    texts = [r.text for r in df.select("text").collect()]
    assert got == Counter((t, *w) for t, w in zip(texts, plain.results(texts), strict=True))


def odd_texts():
    rng = random.Random(8)
    parts = ["'re", "abc", "Ωmega", "é", "각", "12", " ", "  ", "\n", "\t", "!!", "😀", "straße", "<|endoftext|>", "</s>", "<0x41>", "x" * 30, "▁", " ", "\0", "\x1c", "　", "…"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    return texts + [" ", "  ", "a", " a", "a ", "\n", "▁", "日本語テキスト" * 200, "a" * 5000, "ab " * 500, " ".join("internationalisierung" for _ in range(50)), "-" * 3000, "qwertyuiop" * 300]


def test_odd_texts_and_long_runs(spark, plain):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.scored_alignments(df, A, B).collect()}
    assert [got[i] for i in range(len(texts))] == plain.results(texts)


def test_groups_and_links(spark, plain):
    text = "Understanding tokenizers: straße, naïve — 12345!"
    df = spark.createDataFrame([("k", text, 1)], "doc_id string, text string, n_a int")
    row = alignment.alignments(df, A, B, written_out=True).first()
    want = plain.groups(text)
    assert row.groups == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
    assert Counter((x >> 32, x & 0xFFFFFFFF) for x in row.links) == Counter((x, y) for a, b in want for x in a for y in b)
    assert row.n_a == sum(len(a) for a, _ in want) and row.doc_id == "k"


def test_pair_counts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["the cat", "the cat sat", "the the the dog", None])], "doc_id long, text string")
    aligned = alignment.alignments(df, A, B)
    counts = {(r.a, r.b): (r.n, r.best) for r in alignment.pair_counts(aligned).withColumns(dict(zip("ab", alignment.ids_of("link"), strict=True))).collect()}
    assert max(counts.values()) == (3, True) and sum(n == 3 for n, _ in counts.values()) == 1


def test_forgetting_runs_changes_nothing(spark, plain, monkeypatch):
    both, texts = alignment.Tokenizers(A, B), [f"word{i} straße {i} 日本{i}" for i in range(40)]
    monkeypatch.setattr(alignment, "MOST_KNOWN", 10)
    for t in texts:
        codes, (n_a, n_b), sides = both.block([t.encode(), b"", t.encode()])
        want = plain.groups(t)
        assert (codes[0] == codes[2]).all() and len(codes[1]) == 0
        assert n_a.tolist() == [sum(len(a) for a, _ in want), 0] * 1 + [sum(len(a) for a, _ in want)] and n_b[0] == sum(len(b) for _, b in want)
        assert [len(n) for _, n in sides] == [len(set(codes[0]))] * 2


def test_empty_alignment(empty):
    assert alignment.scored_alignments(empty, A, B).count() == 0


def test_blocks_are_gathered_from_small_batches(spark, plain, monkeypatch):
    """Python gets few texts at once and still blocks of many; the session's setting is as before."""
    texts = [f"word{i % 7} straße {i}" for i in range(90)] + [None, "", "x" * 500]
    batches = list(pa.Table.from_pydict({"i": list(range(len(texts))), "t": [(t or "").encode() for t in texts]}).to_batches(max_chunksize=4))
    together = list(common.gathered(iter(batches), 1, 400))
    assert [x for b in together for x in b.column(0).to_pylist()] == list(range(len(texts))) and len(together) < len(batches) / 2
    assert all(b.column(1).nbytes <= 500 + 2 * 4 * 30 for b in together) and not list(common.gathered(iter([]), 1, 400))
    seen = []
    monkeypatch.setattr(alignment, "settled", lambda df, f=alignment.settled: seen.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or f(df))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = alignment.scored_alignments(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B).collect()
    assert seen[0] == "200" and {seen[1]} == {before} == {spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert [got[i] for i in range(len(texts))] == plain.results(texts)
