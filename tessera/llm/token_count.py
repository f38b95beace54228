"""Token counts by finite-state machines.

The merges of a word-based vocabulary are compiled, state by state as texts ask for them, into a
deterministic transducer: its states are what a prefix of a word leaves open, and each transition has
the number of tokens that it adds. A text is cut into chunks, after a blank where there is one near and inside
words where not. A chunk is a map from the state before it to the state after it and the tokens that it adds,
known for the states that can stand there: the one that the letters before the cut lead to. Maps compose
associatively, and a prefix scan by doubling composes those of a block of chunks; only the last one goes on to the next
block. A state that a map does not know (the letters before the cut were too few to tell) is run through its chunk.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from .bpe import Cache, Merges, byte_letters
from .common import utf8, with_results

#: Fixed value: how the vocabulary cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
SHORT = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}

#: Where a text stands: (kind of the open word: 0 none, 1 letters, 2 other signs; the machine's state before the word's last byte; that byte).
State = tuple[int, tuple, int]
START: State = (0, (), -1)


class WordMachine:
    """A deterministic transducer from a word's bytes to its number of tokens.

    A state holds, for each place at which a token could still be open (places of the longest suffix that begins a
    token, from where the letters begin one too), the last token of the prefix that ends there and its count less the present one.
    These decide everything that follows. A word's last byte has transitions of its own, as the vocabulary has
    separate symbols for it. States are numbered as they appear; `moves` has (next state, tokens added).
    """

    def __init__(self, merges: Merges, limit: int = 200_000):
        self.merges, self.limit = merges, limit
        self.starts = {""}
        for t in merges.tokens:
            self.starts.update(t[:i] for i in range(1, len(t)))
        self.number = {t: i for i, t in enumerate(merges.tokens)}
        self.clear()

    def clear(self) -> None:
        #: state: the open suffix, and for each of its places (the first included) the last token before (-1: none) and the count
        self.states = [("", ((-1, 0),))]
        self.index = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        suffix, places = self.states[state]
        whole = suffix + chr(symbol)
        n = len(whole)
        # the token that ends here: the one that fits to what stands before it
        for i in range(n):
            token = self.number.get(whole[i:]) if places[i] else None
            if token is not None:
                before, count = places[i]
                if before < 0 or self.merges.compatible(before, token):
                    break
        else:
            raise ValueError(f"no token ends {whole!r}")
        added = count + 1
        if symbol >= 256:
            made = (-1, added)
        else:
            # a place from which no longer token can come any more does not tell states apart
            starts = self.starts
            known = [(p[0], p[1] - added) if p and whole[i:] in starts else None for i, p in enumerate(places)]
            cut = 0
            while cut < n and known[cut] is None:
                cut += 1
            key = (whole[cut:], (*known[cut:], (token, 0)))
            to = self.index.get(key)
            if to is None:
                to = self.index[key] = len(self.states)
                self.states.append(key)
                self.moves.append({})
            made = (to, added)
        self.moves[state][symbol] = made
        return made

    def key(self, state: int) -> tuple:
        """A state's name, which outlasts clear()."""
        return self.states[state]

    def named(self, key: tuple) -> int:
        at = self.index.get(key)
        if at is None:
            at = self.index[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return at

    def feed(self, state: int, symbols: bytes) -> tuple[int, int]:
        """The state after bytes that are not a word's last, and the tokens that they add."""
        if len(self.states) > self.limit:
            key = self.states[state]
            self.clear()
            state = self.named(key)
        total, moves = 0, self.moves
        for symbol in symbols:
            made = moves[state].get(symbol)
            if made is None:
                made = self.move(state, symbol)
            state = made[0]
            total += made[1]
        return state, total

    def finish(self, state: int, last: int) -> int:
        """The tokens that a word's last byte adds."""
        made = self.moves[state].get(last + 256)
        return (made or self.move(state, last + 256))[1]

    def count(self, word: bytes) -> int:
        state, total = self.feed(0, word[:-1])
        return total + self.finish(state, word[-1])


#: A chunk: from states before it to the state after it and the tokens that it adds.
ChunkMap = dict[State, tuple[State, int]]


def compose(a: ChunkMap, b: ChunkMap) -> ChunkMap:
    """The map of two chunks in a row, for the states that lead through what both know; associative."""
    return {e: (b[x][0], n + b[x][1]) for e, (x, n) in a.items() if x in b}


def scan(maps: list[ChunkMap]) -> list[ChunkMap]:
    """Prefix compositions by doubling: in round r each map takes in the one 2^r before it."""
    step = 1
    while step < len(maps):
        maps = [*maps[:step], *(compose(a, b) for a, b in zip(maps, maps[step:], strict=False))]
        step *= 2
    return maps


class Counter:
    """A word vocabulary read from a tokenizer file."""

    def __init__(self, path: str, cached_words: int = 600_000, cached_runs: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        end = model["end_of_word_suffix"]

        def spell(token: str) -> str:
            if token.endswith(end):
                token = token[: -len(end)]
                return "".join(chr(letters[c]) for c in token[:-1]) + chr(256 + letters[token[-1]])
            return "".join(chr(letters[c]) for c in token)

        singles = [t for c in letters for t in (c, c + end)]
        inner = {t: i for i, t in enumerate(singles)}
        tokens, splits = [spell(t) for t in singles], [None] * len(singles)
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            if a + b not in inner:
                inner[a + b] = len(tokens)
                tokens.append(spell(a + b))
                splits.append((inner[a], inner[b]))
        self.machine = WordMachine(Merges(tokens, splits))
        self.words = regex.compile(WORDS)
        self.going_on = (None, regex.compile(r"\p{L}*+"), regex.compile(r"[^\s\p{L}\p{N}]*+"))
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.known_words = Cache(lambda word: self.machine.count(word.encode()), cached_words)
        self.known_runs = Cache(lambda run: sum([self.known_words[w] for w in self.words.findall(run)]), cached_runs)

    def advance(self, state: State, text: str) -> tuple[State, int]:
        """The state after some text, and the tokens of the words that end in it or before it and were open."""
        kind, key, last = state
        total = 0
        if kind:
            n = self.going_on[kind].match(text).end()
            at = self.machine.named(key)
            if n:
                more = text[:n].encode()
                at, total = self.machine.feed(at, bytes([last]) + more[:-1])
                last = more[-1]
            if n == len(text):
                return (kind, self.machine.key(at), last), total
            total += self.machine.finish(at, last)
            text = text[n:]
        *runs, tail = text.split(" ")
        known = self.known_runs
        total += sum([known[r] for r in runs])
        words = self.words.findall(tail)
        if not words or not tail.endswith(words[-1]) or words[-1] in SHORT or words[-1].isnumeric():
            return START, total + sum([self.known_words[w] for w in words])
        total += sum([self.known_words[w] for w in words[:-1]])
        word = words[-1].encode()
        at, added = self.machine.feed(0, word[:-1])
        kind = 1 if self.going_on[1].match(words[-1]).end() else 2
        return (kind, self.machine.key(at), word[-1]), total + added

    def finish(self, state: State) -> int:
        return self.machine.finish(self.machine.named(state[1]), state[2]) if state[0] else 0

    def chunk_map(self, chunk: str, states: set[State]) -> ChunkMap:
        return {s: self.advance(s, chunk) for s in states}

    def part(self, data: bytes, chunk: int, block: int, back: int) -> int:
        """Tokens of a text without special strings."""
        if len(data) <= chunk:
            state, total = self.advance(START, normalized(data.decode("utf-8", "replace")))
            return total + self.finish(state)
        state, total, waiting, before = START, 0, [], ""
        for text in (*chunks(data, chunk), None):
            if text is not None:
                # the letters before a cut lead from the start state to the state there, or so it seems
                guess = self.advance(START, before[-back:].rpartition(" ")[2])[0] if waiting else state
                waiting.append((text, self.chunk_map(text, {guess})))
                before = text
            if len(waiting) == block or text is None:
                whole = scan([m for _, m in waiting])[-1] if waiting else {}
                if state in whole:
                    state, added = whole[state]
                    total += added
                else:
                    for chunk_text, known in waiting:
                        state, added = known.get(state) or self.advance(state, chunk_text)
                        total += added
                waiting = []
        return total + self.finish(state)

    def count(self, data: bytes, chunk: int = 1 << 15, block: int = 32, back: int = 256) -> int:
        """Tokens of a UTF-8 text, those for special strings in it included. Beside the text, a block of chunks is held at most."""
        if not any(a in data for a in self.added):
            return self.part(data, chunk, block, back)
        total, at = 0, 0
        for found in re.finditer(b"|".join(map(re.escape, self.added)), data):
            total += self.part(data[at : found.start()], chunk, block, back) + 1
            at = found.end()
        return total + self.part(data[at:], chunk, block, back)


def safe_cut(data: bytes, at: int) -> bool:
    """Whether normal form, letter case and words are decided alike on both sides of a place inside a text."""
    if data[at] & 0xC0 == 0x80:
        return False
    after = data[at : at + 4].decode("utf-8", "ignore")[:1].lower()[:1]
    if unicodedata.category(after or " ")[0] == "M" or "\u1160" <= after <= "\u11ff":
        return False  # composes with what stands before
    before = data[max(0, at - 8) : at].decode("utf-8", "ignore").lower()[-2:]
    if before[-1:] == "'":
        return after not in set("stmdrvl")
    return not (before[:1] == "'" and before[1:] in ("r", "v", "l") and after in ("e", "l"))


def chunks(data: bytes, size: int, near: int = 1024) -> Iterator[str]:
    """A text in normalised pieces of about `size` bytes, cut after a blank if one of the last `near` bytes is one."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            blank = data.rfind(b" ", max(at, end - near), end)
            if blank >= 0:
                end = blank + 1
            else:
                while end < len(data) and not safe_cut(data, end):
                    end += 1
        yield normalized(data[at:end].decode("utf-8", "replace"))
        at = end


def normalized(text: str) -> str:
    """NFC, then each letter's own lower case (which capital sigma has one of)."""
    text = text if text.isascii() else unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 2048, keep: list[str] | None = None) -> DataFrame:
    """Append n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to each row.

    A null text is empty: no bytes, no tokens. Rows stay one to one and need no shuffle; an empty table gives none.
    """

    def compute():
        count = counter(path).count

        def run(v):
            counts = [count(t) for t in v[0]]
            return [[len(t) for t in v[0]], counts, [n > limit for n in counts]]

        return run

    return with_results(df, [utf8(f"`{text}`")], "n_bytes long, n_tokens long, over_limit boolean", compute, keep)
