"""Repair of conversations: the cheapest edits that give a legal order of roles, by Dial's bucket queue.

A node is a place between two rows and the state of the legal order there: at the start, after the system's row, after the
user, after the assistant. Keeping, renaming, deleting and inserting rows are arcs of cost 0 to 3, so that the nodes wait in
a ring of buckets by their distance to the end. The audit is the ASCII-least walk along arcs that the distances make tight.

Conversations of up to MOST_ROWS rows are handled as one group each. Longer ones are cut into chunks: each chunk's distances
between its borders are a matrix of states, the matrices of a conversation are folded from its end, and the chunks are then
walked on their own. Only the digest of a repaired conversation is made in one task, which reads its lines in order and holds
one batch, since a digest is a sequence.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.checkpoints import settled
from ..operators.ordered import numbered
from .common import small, with_results

#: A conversation with more rows, or more bytes of text, is cut into chunks of that many rows.
MOST_ROWS, MOST_BYTES = 4096, 32 << 20
#: White space of the contract, and what ends a whole text.
BLANK, ENDS = " \t\n\x0b\x0c\r", ".!?"

START, SYSTEM, USER, ASSISTANT = range(4)
#: state: (state before, role initial that leads here); the legal orders are s?(ua)+ or nothing.
INTO = {START: [], SYSTEM: [(START, "s")], USER: [(START, "u"), (SYSTEM, "u"), (ASSISTANT, "u")], ASSISTANT: [(USER, "a")]}
OUT_OF = {(p, x): q for q, arcs in INTO.items() for p, x in arcs}
#: What may be inserted, or a row be renamed to, in each state.
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
FAR = 1 << 60

RESULTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows after the damage that crc32(conv_id:turn) % 20 names; a dropped one is `gone`.

    0 drops a row, 1 empties its text, 2 takes its [.!?], 3 repeats it, 4 makes its role user. Null roles and texts, and null
    ids and turns in the checksum, are one space.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.col("kind") == 0, F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("gone"))


def is_truncated(text: str) -> bool:
    """Whether a text that is not blank lacks its end."""
    return text.rstrip(BLANK)[-1] not in ENDS


def distances(rows: list[tuple[str, bool, int]], ahead: list[int]) -> list[int]:
    """Least costs from each node, 4 * place + state, to the end; `ahead` has them for the states behind the last row.

    rows: (role initial, must it go, what it costs more if it stays). Arcs cost 3 at most, so the ring has a bucket for each
    distance from the least open one to 3 more, or to the largest of `ahead`.
    """
    near = [a for a in ahead if a < FAR]
    least, width = min(near), max(near) - min(near) + 4
    ring: list[list[int]] = [[] for _ in range(width)]
    dist = [FAR] * (4 * len(rows) + 4)
    for state, a in enumerate(ahead):
        if a < FAR:
            dist[4 * len(rows) + state] = a
            ring[a % width].append(4 * len(rows) + state)
    waiting, d = len(near), least
    while waiting:
        bucket = ring[d % width]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != d:
                continue  # it was met again, nearer
            place, state = divmod(node, 4)
            arcs = [(4 * place + p, 2) for p, x in INTO[state] if x != "s"]
            if place:
                initial, must_go, more = rows[place - 1]
                arcs.append((node - 4, 3))
                if not must_go:
                    arcs += [(4 * place - 4 + p, more if x == initial else more + 2) for p, x in INTO[state] if x in (initial, "u", "a")]
            for before, cost in arcs:
                if d + cost < dist[before]:
                    dist[before] = d + cost
                    ring[(d + cost) % width].append(before)
                    waiting += 1
        d += 1
    return dist


def walk(rows: list[tuple[str, bool, int]], dist: list[int], state: int, last: bool = True) -> tuple[str, int, list[tuple[str, str]], str]:
    """The ASCII-least cheapest edits from a state before the first row: their initials, the state behind the last row, each
    row's edit (initials of the rows inserted before it; - to delete, = to keep, else its new role's initial), and what is
    inserted at the end, which only the `last` chunk does."""
    place, audit, edits, before = 0, [], [], ""
    while True:
        d = dist[4 * place + state]
        if place == len(rows) and (not last or d == 0):
            return "".join(audit), state, edits, before
        new = NEXT[state]
        initial, must_go, more = rows[place] if place < len(rows) else ("", True, 0)
        if place < len(rows) and d == 3 + dist[4 * place + 4 + state]:
            audit.append("D")
            edits.append((before, "-"))
            place, before = place + 1, ""
        elif d == 2 + dist[4 * place + OUT_OF[state, new]]:
            audit.append("I")
            before += new
            state = OUT_OF[state, new]
        elif not must_go and (state, initial) in OUT_OF and d == more + dist[4 * place + 4 + OUT_OF[state, initial]]:
            audit.append("K")
            edits.append((before, "="))
            place, before, state = place + 1, "", OUT_OF[state, initial]
        else:
            audit.append("R")
            edits.append((before, new))
            place, before, state = place + 1, "", OUT_OF[state, new]


def inserted(initials: str) -> list[str]:
    return [NAMES[x] + ":" for x in initials]


def edited(edit: tuple[str, str], role: str, text: str) -> list[str]:
    """The lines that a row becomes."""
    before, then = edit
    return inserted(before) + ([] if then == "-" else [f"{role if then == '=' else NAMES[then]}:{text}"])


def repaired(rows: list[tuple[int | None, str, str]]) -> tuple:
    """The values of RESULTS for one conversation's rows (turn, role, text) in order."""
    seen, faults, table = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text in rows:
        fault = "blank" if not text.strip(BLANK) else "duplicate" if (role, text) in seen else "truncated" if is_truncated(text) else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        table.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(table, table[1:]))
    dist = distances(table, [0, FAR, FAR, 0])
    audit, _, edits, tail = walk(table, dist, START)
    lines = [line for edit, (_, role, text) in zip(edits, rows, strict=True) for line in edited(edit, role, text)] + inserted(tail)
    return gaps, *faults.values(), illegal, dist[START], audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired conversations of rows (conv_id, turn, role, text, gone) that arrive in order."""
    at, rows, begun = None, [], False

    def batch(ids: list, made: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(ids, kind), *[pa.array([m[i] for m in made], pa.int64() if i < 6 else pa.string()) for i in range(8)]]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *[c.split()[0] for c in RESULTS.split(", ")]])

    kind = None
    for arrived in batches:
        ids, made, kind = [], [], arrived.schema.field(0).type
        for conv, turn, role, text, gone in zip(*[c.to_pylist() for c in arrived.columns], strict=True):
            if begun and conv != at:
                ids.append(at)
                made.append(repaired(rows))
                rows = []
            at, begun = conv, True
            if not gone:
                rows.append((turn, role, text))
        yield batch(ids, made, kind)
    if begun:
        yield batch([at], [repaired(rows)], kind)


def in_order(turn: str = "turn") -> list[Column]:
    return [F.col(turn).asc_nulls_first(), F.col("role"), F.col("text")]


def repair_conversations(conversations: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(conv_id, RESULTS): each conversation of `conversations` after damaged(), its faults, and the cheapest repair.

    Rows stand by turn, nulls first, those of one turn by role and text. A null conv_id is a conversation too; one without any
    row after the damage has zeros, an empty audit and the digest of nothing. A row whose role is empty can't be kept.
    Other columns are not read. An empty table gives none.
    """
    kind = dict(conversations.dtypes)["conv_id"]
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0))
    counts = conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    long_ones = settled(counts.filter((F.col("n") > most_rows // 2) | (F.col("b") > most_bytes)).select("conv_id", F.monotonically_increasing_id().alias("c")))
    rows = damaged(conversations)
    if not long_ones.take(1):
        return _short(rows, kind)
    few = small(long_ones.select(F.col("conv_id").alias("_conv"), "c"), 100_000)
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    short = _short(rows.join(few, same, "left_anti"), kind)
    return short.unionByName(_long(rows.join(few, same).drop("_conv"), long_ones, most_rows))


def _short(rows: DataFrame, kind: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", *in_order()).mapInArrow(grouped, f"conv_id {kind}, {RESULTS}")


def _table(codes: list[str]) -> list[tuple[str, bool, int]]:
    """Rows of a chunk from their codes: what must go (D), is truncated (t) or neither (-), and the role's initial."""
    return [(c[1:], c[0] == "D", int(c[0] == "t")) for c in codes]


def _matrix(codes: list[str]) -> list[int]:
    """Costs from each state before a chunk (rows) to each one behind it; -1 for no way."""
    table = _table(codes)
    to = [distances(table, [0 if e == q else FAR for e in range(4)])[:4] for q in range(4)]
    return [-1 if to[q][p] >= FAR else to[q][p] for p in range(4) for q in range(4)]


def _ahead(matrices: list[list[int]]) -> list[list[int]]:
    """Costs from each state behind each chunk to the conversation's end, and before the first chunk as the last entry."""
    ahead, out = [0, FAR, FAR, 0], []
    for matrix in reversed(matrices):
        out.append([-1 if a >= FAR else a for a in ahead])
        ahead = [min(matrix[4 * p + q] + ahead[q] if matrix[4 * p + q] >= 0 else FAR for q in range(4)) for p in range(4)]
    return out[::-1] + [[-1 if a >= FAR else a for a in ahead]]


def _walks(codes: list[str], ahead: list[int], last: bool) -> tuple[list[int], list[str], list[list[str]]]:
    """For each state before a chunk: the state behind it, the audit, and each row's edit with one more for the end."""
    table = _table(codes)
    dist = distances(table, [FAR if a < 0 else a for a in ahead])
    exits, audits, edits = [], [], []
    for state in range(4):
        if dist[state] >= FAR:
            exits.append(-1)
            audits.append("")
            edits.append([])
            continue
        audit, behind, made, tail = walk(table, dist, state, last)
        exits.append(behind)
        audits.append(audit)
        edits.append([before + then for before, then in made] + [tail])
    return exits, audits, edits


def _entries(exits: list[list[int]]) -> list[int]:
    state, out = START, []
    for row in exits:
        out.append(state)
        state = row[state]
    return out


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, repaired_sha256) of rows (c, line) in order, hashed as they come."""
    at, digest = None, None
    for arrived in batches:
        for c, line in zip(*[x.to_pylist() for x in arrived.columns], strict=True):
            if c != at:
                if digest is not None:
                    yield pa.RecordBatch.from_pydict({"c": [at], "repaired_sha256": [digest.hexdigest()]})
                at, digest = c, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
    if digest is not None:
        yield pa.RecordBatch.from_pydict({"c": [at], "repaired_sha256": [digest.hexdigest()]})


def _by_row(function: object) -> object:
    """with_results' function of columns from one of single rows that gives a tuple."""
    return lambda: lambda columns: [list(x) for x in zip(*[function(*row) for row in zip(*columns, strict=True)], strict=True)]


def _long(rows: DataFrame, conversations: DataFrame, most_rows: int) -> DataFrame:
    """repair_conversations() for conversations of any length: rows (c, turn, role, text, gone) of `conversations` (conv_id, c)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blank = ~F.rlike(F.col("text"), F.lit(r"[^\x20\x09-\x0D]"))
    cut = ~F.rlike(F.col("text"), F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    kept = rows.filter("not gone").select(
        "c", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), cut.alias("cut"),
        digest.alias("digest"), F.monotonically_increasing_id().alias("row"),
    )
    kept = settled(kept)
    # the first of equal rows: counted before it is shuffled, and joined, so that AQE can split the rows of one that is frequent
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")
    first = kept.groupBy("c", "digest").agg(F.min(order).alias("_first"))
    marked = kept.join(first, ["c", "digest"]).withColumn("again", F.col("_first.row") != F.col("row"))
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated")
    marked = settled(marked.select("c", "turn", "role", "text", "initial", "row", fault.alias("fault")))
    placed = settled(numbered(marked, [F.col("c"), *in_order(), F.col("row")]).withColumn("chunk", F.floor(F.col("place") / most_rows)))

    flag = F.when(F.col("fault").isin("blank", "duplicate"), "D").when(F.col("fault") == "truncated", "t").otherwise("-")
    by_place = F.sort_array(F.collect_list(F.struct("place", F.concat(flag, "initial").alias("code"))))
    chunks = placed.groupBy("c", "chunk").agg(by_place.alias("s"), F.min("place").alias("start"))
    chunks = chunks.select("c", "chunk", "start", F.transform("s", lambda s: s["code"]).alias("codes"))
    chunks = settled(with_results(chunks, [F.col("codes")], "matrix array<int>", _by_row(lambda codes: (_matrix(codes),))))

    inside = F.aggregate(
        F.sequence(F.lit(2), F.greatest(F.size("codes"), F.lit(2))), F.lit(0).cast("long"),
        lambda n, i: n + F.when((i <= F.size("codes")) & ~F.concat(F.substring(F.element_at("codes", i - 1), 2, 1), F.substring(F.element_at("codes", i), 2, 1)).isin(*LEGAL), 1).otherwise(0),
    )
    ends = lambda i: F.substring(F.element_at("codes", i), 2, 1)
    row = F.struct("chunk", "matrix", inside.alias("illegal"), ends(1).alias("head"), ends(-1).alias("tail"))
    whole = chunks.groupBy("c").agg(F.sort_array(F.collect_list(row)).alias("s"))
    between = F.size(F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i > 0) & ~F.concat(F.get("s", i - 1)["tail"], F.get("s", i)["head"]).isin(*LEGAL)))
    illegal = F.aggregate("s", F.lit(0).cast("long"), lambda n, s: n + s["illegal"]) + between
    whole = whole.select("c", F.transform("s", lambda s: s["chunk"]).alias("numbers"), illegal.alias("illegal"), F.transform("s", lambda s: s["matrix"]).alias("matrices"))
    whole = settled(with_results(whole, [F.col("matrices")], "ahead array<array<int>>", _by_row(lambda m: (_ahead(m),)), keep=["c", "numbers", "illegal"]))
    behind = whole.select("c", F.posexplode("numbers").alias("i", "chunk"), F.col("ahead"), F.size("numbers").alias("n"))
    behind = behind.select("c", "chunk", F.get("ahead", F.col("i")).alias("right"), (F.col("i") == F.col("n") - 1).alias("last"))
    ways = with_results(
        chunks.join(behind, ["c", "chunk"]), [F.col("codes"), F.col("right"), F.col("last")],
        "exits array<int>, audits array<string>, edits array<array<string>>", _by_row(_walks), keep=["c", "chunk", "start"],
    )
    ways = settled(ways)
    states = ways.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("chunk", "exits"))).alias("s"))
    states = states.select("c", F.transform("s", lambda s: s["chunk"]).alias("numbers"), F.transform("s", lambda s: s["exits"]).alias("exits"))
    states = with_results(states, [F.col("exits")], "entries array<int>", _by_row(lambda e: (_entries(e),)), keep=["c", "numbers"])
    states = states.select("c", F.explode(F.arrays_zip("numbers", "entries")).alias("z")).select("c", F.col("z.numbers").alias("chunk"), F.col("z.entries").alias("state"))
    taken = ways.join(states, ["c", "chunk"]).select("c", "chunk", "start", F.get("audits", F.col("state")).alias("audit"), F.get("edits", F.col("state")).alias("edits"))
    taken = settled(taken)

    audits = taken.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("chunk", "audit"))).alias("s"))
    audits = audits.select("c", F.array_join(F.transform("s", lambda s: s["audit"]), "").alias("audit"))
    # the entry after a chunk's rows belongs to no row
    edits = taken.select("c", "start", F.size("edits").alias("n"), F.posexplode("edits").alias("i", "edit"))
    edits = edits.select("c", (F.col("start") + F.col("i")).alias("place"), (F.col("i") == F.col("n") - 1).alias("at_end"), "edit")
    line = lambda x: F.when(x == "u", F.lit("user:")).otherwise(F.lit("assistant:"))
    before = lambda x: F.transform(F.filter(F.split(x, ""), lambda y: y != ""), line)
    then = F.substring("edit", -1, 1)
    own = F.when(then == "=", F.concat("role", F.lit(":"), "text")).when(then == "u", F.concat(F.lit("user:"), "text")).when(then == "a", F.concat(F.lit("assistant:"), "text"))
    met = placed.join(edits.filter("not at_end"), ["c", "place"])
    lines = met.select("c", (2 * F.col("place")).alias("at"), F.array_compact(F.concat(before(F.expr("left(edit, length(edit) - 1)")), F.array(own))).alias("x"))
    lines = lines.unionByName(edits.filter("at_end").select("c", (2 * F.col("place") - 1).alias("at"), before(F.col("edit")).alias("x")))
    lines = lines.filter(F.size("x") > 0).select("c", "at", F.array_join("x", "\n").alias("line"))
    hashed = lines.repartition(parts, "c").sortWithinPartitions("c", "at").select("c", "line").mapInArrow(_lines, "c long, repaired_sha256 string")

    counts = placed.groupBy("c").agg(
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.countDistinct("turn").alias("turns"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    counts = counts.select("c", gaps.alias("gaps"), "blank", "duplicate", "truncated")
    cost = F.get(F.element_at("ahead", -1), F.lit(START)).cast("long").alias("cost")
    out = conversations.join(counts, "c", "left").join(whole.select("c", "illegal", cost), "c", "left").join(audits, "c", "left").join(hashed, "c", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
