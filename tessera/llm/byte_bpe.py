"""Byte-level byte-pair encoding by recursive DuckDB queries inside each partition, and decoding by an ordered aggregation.

The words of a block of texts (the pattern's matches) are rows of one recursive query: a row is a token's position in its
word with the token behind it. Each step joins the rows with the merge table, takes each word's leftmost pair of least rank
and contracts it, until no word has a pair left. Decoding joins rows (text, place, id) with the vocabulary and aggregates
the tokens' bytes by place.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import PIECES, RESULTS
from .common import utf8, with_results

#: Rows that one query makes at most, about: a word of n bytes makes n * n / 2.
MOST_ROWS = 1 << 21
#: Words longer than this are encoded in windows that overlap by half.
WINDOW = 128
#: Words, and runs between blanks, remembered between blocks.
MOST_WORDS, MOST_RUNS = 600_000, 600_000

#: One step's rows are (word, position, next position, token, next token, what merging them gives); key packs the least
#: merge, its position and the next one into a number, so that the least key is the leftmost pair of least rank.
MERGE = """
with recursive step as (
  select word, pos, next_pos, token, next_token, merged, 0 as k from words left join merges using (token, next_token)
  union all
  select word, pos, next_pos, token, next_token, merges.merged, k + 1 from (
    select word, k, next_pos,
      case when pos = spot then -1 when pos = behind then spot else pos end as pos,
      case when pos = behind then made else token end as token,
      case when next_pos = spot then made else next_token end as next_token
    from step join (
      select word, least >> 46 as made, (least >> 23) & 8388607 as spot, least & 8388607 as behind from (
        select word, min((merged::bigint << 46) | (pos::bigint << 23) | next_pos) as least from step where merged is not null group by word)
    ) using (word))
  left join merges using (token, next_token)
  where pos >= 0
)
select word, token from step join (select word, max(k) as k from step group by word) using (word, k) order by word, pos
"""

DECODE = """
select part, string_agg(letters, '' order by place) as decoded from tokens join vocabulary using (token) group by part order by part
"""


class Numbers(dict):
    """Numbers of the keys met, in their order."""

    def __missing__(self, key: str | bytes) -> int:
        self[key] = made = len(self)
        return made


def segments(text: str, most: int = 1 << 19) -> Iterator[str]:
    """A text cut before single blanks between other characters, where a match of the pattern always begins."""
    at = 0
    while len(text) - at > most and (cut := CUT.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


CUT = regex.compile(r"(?<=\S)(?= \S)")


def is_odd(run: str) -> bool:
    """Whether a text cut at all blanks was not to be cut beside this run (a wider class of white space may say so too)."""
    body = run[1:] if run[0] == " " else run
    return not body or body[0].isspace() or body[-1].isspace()


class Encoder:
    """A DuckDB connection with the merge table of a vocabulary of ranks, for one worker's tasks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]
        # whatever way a token is cut in two tokens, joining them has its rank
        merges = [(ranks[t[:n]], ranks[t[n:]], i) for t, i in ranks.items() for n in range(1, len(t)) if t[:n] in ranks and t[n:] in ranks]
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB"})
        self.con.execute("set temp_directory = ''")
        columns = [pa.array(c, pa.int32()) for c in zip(*merges, strict=True)]
        self.table("merges", pa.table(dict(zip(("token", "next_token", "merged"), columns, strict=True))))
        # bytes as the letters of their numbers
        letters = pa.table({"token": pa.array(list(ranks.values()), pa.int32()), "letters": [t.decode("latin-1") for t in ranks]})
        self.table("vocabulary", letters)
        self.pattern = regex.compile(PIECES)
        self.known_words: dict[str, bytes] = {}
        self.forget_runs()

    def forget_runs(self) -> None:
        """Runs by number, their ids one after another, where each one's begin, how many they are, and whether the run is odd."""
        self.number, self.pool, self.spans = Numbers(), np.empty(0, "<u4"), np.empty((3, 0), np.int64)

    def table(self, name: str, rows: pa.Table) -> None:
        self.con.register("arriving", rows)
        self.con.execute(f"create or replace table {name} as select * from arriving")
        self.con.unregister("arriving")

    def contract(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, little-endian; as many words a query as MOST_ROWS lets in."""
        out, start, rows = [], 0, 0
        for i, word in enumerate(words):
            rows += len(word) * (len(word) + 1) // 2 + 1
            if rows >= MOST_ROWS or i == len(words) - 1:
                out += self._contract(words[start : i + 1])
                start, rows = i + 1, 0
        return out

    def _contract(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(w) for w in words])
        token = self.single[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(sizes)
        pos = np.arange(len(token)) - np.repeat(ends - sizes, sizes)
        next_token, next_pos = np.append(token[1:], -1), pos + 1
        next_token[ends - 1] = -1
        number = np.repeat(np.arange(len(words)), sizes)
        columns = {"word": number, "pos": pos, "next_pos": next_pos, "token": token, "next_token": next_token}
        self.con.register("words", pa.table({c: pa.array(x.astype(np.int32)) for c, x in columns.items()}))
        found = self.con.sql(MERGE).to_arrow_table()
        self.con.unregister("words")
        packed = found["token"].to_numpy().astype("<u4").tobytes()
        bounds = (np.flatnonzero(np.diff(found["word"].to_numpy(), prepend=-1, append=-1)) * 4).tolist()
        return [packed[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of words, little-endian. Long ones are encoded in windows, joined where two share a token.

        A row of tokens of which every two neighbours encode to themselves is the encoding of the whole, as merging does the
        same to two tokens whatever stands around them; neighbours in a window's encoding do, so two windows' rows may be
        joined at a token of both. Without such a token, the windows are widened, up to the word.
        """
        data = [w.encode() for w in words]
        short = [i for i, w in enumerate(data) if len(w) <= WINDOW]
        out: list[bytes | None] = [None] * len(data)
        for i, ids in zip(short, self.contract([data[i] for i in short]), strict=True):
            out[i] = ids
        todo, width = [i for i, ids in enumerate(out) if ids is None], WINDOW
        while todo:
            places = {i: [*range(0, max(1, len(data[i]) - width // 2), width // 2)] for i in todo}
            number = Numbers()
            cut = {i: [number[data[i][p : p + width]] for p in places[i]] for i in todo}
            ids = [np.frombuffer(row, "<u4") for row in self.contract(list(number))]
            for i in todo:
                row = self.join([ids[n] for n in cut[i]], places[i])
                out[i] = None if row is None else row.astype("<u4").tobytes()
            todo, width = [i for i in todo if out[i] is None], width * 2
        return out

    def join(self, windows: list[np.ndarray], places: list[int]) -> np.ndarray | None:
        """One row of ids from overlapping windows that begin at `places`; None if two have no token in common."""
        rows, ids, ends = [], windows[0], np.cumsum(self.sizes[windows[0]])
        for following, place in zip(windows[1:], places[1:], strict=True):
            later = place + np.cumsum(self.sizes[following])
            # tokens of both: equal ids with equal ends
            _, mine, other = np.intersect1d(ends << 20 | ids, later << 20 | following, assume_unique=True, return_indices=True)
            if not len(mine):
                return None
            rows.append(ids[: mine[0] + 1])
            ids, ends = following[other[0] + 1 :], later[other[0] + 1 :]
        return np.concatenate([*rows, ids])

    def learn(self) -> None:
        """Encode the runs that got the last numbers."""
        new = len(self.number) - self.spans.shape[1]
        if not new:
            return
        fresh = list(islice(reversed(self.number), new))[::-1]
        if len(self.known_words) > MOST_WORDS:
            self.known_words = {}
        known = self.known_words
        cut = [self.pattern.findall(r) for r in fresh]
        words = list({w: None for row in cut for w in row if w not in known})
        known.update(zip(words, self.encode_words(words), strict=True))
        packed = [known[w] for row in cut for w in row]
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        bounds = np.append(0, np.cumsum(sizes))[np.cumsum([0, *map(len, cut)])] + len(self.pool)
        self.pool = np.append(self.pool, np.frombuffer(b"".join(packed), "<u4"))
        self.spans = np.hstack([self.spans, [bounds[:-1], np.diff(bounds), np.fromiter(map(is_odd, fresh), np.int64, new)]])
        for word in words:
            if len(word) > 64:
                del known[word]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Runs that occurred before are looked up; what is remembered is a matter of time only."""
        number = self.number
        codes = [None if "\0" in t else [number[r] for r in t.replace(" ", "\0 ").split("\0") if r] for t in texts]
        self.learn()
        odd = self.spans[2].astype(bool)
        for i, row in enumerate(codes):
            if row is None or odd[row].any():
                codes[i] = [number[r] for r in CUT.split(texts[i]) if r]
        self.learn()
        runs_before = np.cumsum([0, *map(len, codes)])
        starts, n, _ = self.spans[:, np.fromiter(chain.from_iterable(codes), np.int64, runs_before[-1])]
        ends = np.cumsum(n)
        ids = self.pool[np.arange(n.sum()) + np.repeat(starts - (ends - n), n)]
        if len(number) > MOST_RUNS or len(self.pool) > 8 * MOST_RUNS:
            self.forget_runs()
        return np.split(ids, np.append(0, ends)[runs_before[1:-1]])

    def decode(self, rows: list[np.ndarray], most: int = 1 << 18, query: int = 1 << 20) -> list[list[bytes]]:
        """The bytes that each row of ids stands for, in pieces of `most` tokens at most, about `query` tokens a query."""
        cut = [(i, row[at : at + most]) for i, row in enumerate(rows) for at in range(0, len(row), most)]
        out: list[list[bytes]] = [[] for _ in rows]
        start, size = 0, 0
        for n, (_, piece) in enumerate(cut):
            size += len(piece)
            if size >= query or n == len(cut) - 1:
                for (i, _), decoded in zip(cut[start : n + 1], self._decode([p for _, p in cut[start : n + 1]]), strict=True):
                    out[i].append(decoded)
                start, size = n + 1, 0
        return out

    def _decode(self, pieces: list[np.ndarray]) -> list[bytes]:
        token = np.concatenate(pieces).astype(np.int32)
        part = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(p) for p in pieces])
        self.con.register("tokens", pa.table({"part": part, "place": np.arange(len(token), dtype=np.int32), "token": token}))
        found = self.con.sql(DECODE).to_arrow_table()["decoded"].to_pylist()
        self.con.unregister("tokens")
        return [letters.encode("latin-1") for letters in found]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_decode_ranks(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: bool = False) -> DataFrame:
    """Append n_tokens, the digest of the ids, that of the bytes decoded from them, and with ids=True the ids.

    As the library of rank files does with bpe.PIECES as pattern and no special tokens: their strings are plain text. A null text
    is empty: no tokens, digests of nothing. Texts are taken in segments, so besides the ids of ids=True no more than a block
    of text is in memory at a time. Rows stay one to one and need no shuffle; an empty table gives none.
    """

    def compute():
        engine = encoder(path)

        def block(columns: list[list]) -> list[list]:
            values = columns[0]
            state = [[0, hashlib.sha256(), hashlib.sha256(), []] for _ in values]
            todo: list[tuple[int, str]] = []

            def flush() -> None:
                rows = engine.encode([t for _, t in todo])
                for (i, _), row, decoded in zip(todo, rows, engine.decode(rows), strict=True):
                    state[i][0] += len(row)
                    state[i][1].update(row.astype("<u4").tobytes())
                    for d in decoded:
                        state[i][2].update(d)
                    if ids:
                        state[i][3].append(row.astype(np.int32))
                todo.clear()

            size = 0
            for i, value in enumerate(values):
                for segment in segments(value.decode("utf-8", "replace")):
                    todo.append((i, segment))
                    size += len(segment)
                    if size >= 1 << 22:
                        flush()
                        size = 0
            flush()
            out = [[s[0] for s in state], [s[1].hexdigest() for s in state], [s[2].hexdigest() for s in state]]
            return [*out, [np.concatenate(s[3]) for s in state]] if ids else out

        return block

    return with_results(df, [utf8(f"`{text}`")], RESULTS + (", ids array<int>" if ids else ""), compute, keep)
