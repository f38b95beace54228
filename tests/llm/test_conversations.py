"""Repair of conversations, against a search through all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from tessera.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, cost string, GAPS int"


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def plain_repair(rows):
    """Best first over (cost, audit), whole strings compared, with the roles so far as the state."""
    faults, seen = [], []
    for _, role, text in rows:
        ends = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends[-1] not in ".!?" else "")
        seen.append((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(rows, rows[1:])]
    fits = lambda s: re.fullmatch("|".join(["", "s", "s?(ua)+", "s?(ua)*u"]), s)
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, order, lines = heapq.heappop(queue)
        # what comes is decided by the place and by the last role
        if (at, order[-1:]) in done:
            continue
        done.add((at, order[-1:]))
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", order):
            return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
        steps = [(2, "I", 0, r[0], f"{r}:") for r in ("user", "assistant")]
        if at < len(rows):
            _, role, text = rows[at]
            steps.append((3, "D", 1, "", None))
            if faults[at] not in ("blank", "duplicate"):
                more = int(faults[at] == "truncated")
                steps += [(2 + more, "R", 1, r[0], f"{r}:{text}") for r in ("user", "assistant")]
                steps += [(more, "K", 1, role[:1], f"{role}:{text}")] if role[:1] else []
        for c, letter, on, initial, line in steps:
            if fits(order + initial):
                heapq.heappush(queue, (cost + c, audit + letter, at + on, order + initial, lines + ((line,) if line is not None else ())))
    raise AssertionError


def odd_rows():
    rng = random.Random(7)
    texts = ["Hello there.", "What?", "no end", " \n", "", None, "Yes!\n", "fine. ", "A.", "B.", "C!", "é?", "long " * 30 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = [(conv, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for conv in [*range(40), None] for _ in range(rng.randint(1, 12))]
    for conv in range(100, 180):
        rows += [(conv, t, "system" if t == 0 and conv % 3 == 0 else ("user", "assistant")[t % 2], rng.choice(texts[:3] + ["D.", "E.", "F.", "G.", "H."]) + f" {t}.") for t in range(rng.randint(1, 9))]
    rows += [(500, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(300)]
    rows += [(501, t // 3, rng.choice(roles), rng.choice(texts)) for t in range(200)]
    return rows + rows[:5]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in odd_rows()], SCHEMA).repartition(3).cache()


def results(df):
    names = [c.split()[0] for c in conversations.RESULTS.split(", ")]
    return {r["conv_id"]: tuple(r[c] for c in names) for r in df.select("conv_id", *names).collect()}


@pytest.mark.parametrize("most_rows", [4096, 6, 2])
def test_against_a_search(odd, most_rows):
    """Whole groups, and chunks of a few rows whose matrices are folded."""
    out = conversations.repair_conversations(odd, most_rows=most_rows)
    assert [c for c, _ in out.dtypes] == ["conv_id", *[c.split()[0] for c in conversations.RESULTS.split(", ")]]
    want = {c: plain_repair(rows) for c, rows in plain_damage(odd_rows()).items()}
    got = results(out)
    assert out.count() == len(want) and got == want


def test_given_tables(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    want = {c: plain_repair(r) for c, r in plain_damage([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]).items()}
    assert results(conversations.repair_conversations(df)) == want


def test_conversation_without_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 1, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    for most_rows in (4096, 1):
        assert results(conversations.repair_conversations(df, most_rows)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_many_equal_rows_in_chunks(spark):
    """A key that holds most rows: copies of one row in one conversation and one turn."""
    rows = [(1, 7, "user", "Again.")] * 500 + [(1, t, ("assistant", "user")[t % 2], f"Turn {t}.") for t in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = plain_repair(plain_damage(rows)[1])
    assert results(conversations.repair_conversations(df, most_rows=16)) == {1: want}


def test_empty_conversations(spark):
    df = spark.createDataFrame([], T._parse_datatype_string(SCHEMA))
    assert conversations.repair_conversations(df).count() == 0


def test_string_ids(spark):
    df = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Ho."), (None, 0, "user", "x")], "conv_id string, turn int, role string, text string")
    want = {c: plain_repair(r) for c, r in plain_damage([tuple(r) for r in df.collect()]).items()}
    assert results(conversations.repair_conversations(df)) == want
