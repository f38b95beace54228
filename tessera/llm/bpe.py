"""Byte-pair encoding by backtracking, and decoding by an offset table.

For merges whose ids follow their rank, the encoding of a text is the one row of tokens in which every
two neighbours are compatible: a pair is if merging would not have joined across their border first.
The encoder takes the longest token at each place (an Aho-Corasick automaton finds them in one pass),
checks it against the token before, tries its next shorter prefix token if they don't fit, and steps
back if none fits. Each place is left at most once, so the time is linear.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import utf8, with_results

#: Fixed value: how the byte-level vocabularies cut a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

RESULTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """Letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Ranked pairs over arbitrary symbols: splits of tokens, and which neighbours are compatible.

    tokens: the symbol strings by id, single symbols first; pairs: (left id, right id) of the token, None for
    single symbols. Later merges must have larger ids.
    """

    def __init__(self, tokens: list[str], pairs: list[tuple[int, int] | None]):
        self.tokens, self.pairs = tokens, pairs
        self.merged = {p: i for i, p in enumerate(pairs) if p is not None}
        self.fits: dict[tuple[int, int], bool] = {}
        number = {t: i for i, t in enumerate(tokens)}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        # the next shorter token that begins a token; -1 for none
        self.shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in tokens]
        self.size = [len(t) for t in tokens]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between these two tokens alone."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= 200_000:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the later of the two sides' last merges again and again: the symbols at the border then are what
        # merging has there at that time, and a merge of them with an earlier rank than what was undone crosses it.
        undone = len(self.tokens)
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < undone:
                return False
            a, b = self.pairs[left], self.pairs[right]
            if a is None and b is None:
                return True
            # of equal merges the left one comes first, so the right one is undone first
            if b is None or (a is not None and left > right):
                undone, left = left, a[1]
            else:
                undone, right = right + 1, b[0]

    def encode(self, text: str) -> list[int]:
        """Token ids of a string all of whose symbols are in the vocabulary."""
        n = len(text)
        longest = [-1] * n
        for end, (size, token) in self.automaton.iter(text):
            longest[end - size + 1] = token  # ends ascend, so the last one is the longest
        out: list[int] = []
        open_ = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0] if n else -1
        while at < n:
            while token >= 0:
                end = at + self.size[token]
                if open_[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif out:
                open_[at] = 0  # nothing goes on from here
                token = out.pop()
                at -= self.size[token]
                # take up the token before where it was left
                token = self.shorter[token]
            else:
                raise ValueError(f"no tokens for {text!r}")
        return out


class Cache(dict):
    """Results by short keys, up to a number, beyond which it starts anew."""

    def __init__(self, make: Callable[[str], bytes | int], most: int, longest: int = 64):
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key: str) -> bytes | int:
        made = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = made
        return made


class Vocabulary:
    """A byte-level vocabulary read from a tokenizer file, with caches of the pieces, and of the runs between blanks, met."""

    def __init__(self, path: str, cached_pieces: int = 400_000, cached_runs: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        ids = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        spell = lambda s: "".join(chr(letters[c]) for c in s)
        # inner ids follow the rank; outer ones are the file's
        inner = {c: i for i, c in enumerate(letters)}
        tokens, splits = [chr(b) for b in letters.values()], [None] * len(letters)
        outer = [ids[c] for c in letters]
        for a, b in pairs:
            if a + b in inner:
                continue  # a token that an earlier merge makes
            inner[a + b] = len(tokens)
            tokens.append(spell(a + b))
            splits.append((inner[a], inner[b]))
            outer.append(ids[a + b])
        self.merges = Merges(tokens, splits)
        self.outer = np.array(outer, np.uint32)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.pieces = regex.compile(PIECES)
        self.odd_blanks = regex.compile(r"\s\s|^\s|\s$")
        self.known_pieces = Cache(self.piece, cached_pieces)
        self.known_runs = Cache(lambda run: self.whole(" " + run), cached_runs)
        # the offset table: token i's bytes are blob[offsets[i]:offsets[i + 1]]
        words = {i: bytes(letters[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        parts = [words.get(i, b"") for i in range(max(words) + 1)]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def piece(self, piece: str) -> bytes:
        return self.outer[self.merges.encode(piece.encode().decode("latin-1"))].astype("<u4").tobytes()

    def whole(self, text: str) -> bytes:
        known = self.known_pieces
        return b"".join([known[p] for p in self.pieces.findall(text)])

    def ids_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = []
        for i, part in enumerate(self.split_added.split(text) if self.split_added else [text]):
            if i % 2:
                out.append(self.added[part].to_bytes(4, "little"))
            elif self.odd_blanks.search(part):
                out.append(self.whole(part))
            elif part:
                # each blank stands alone between other characters and begins a piece, so that no piece crosses a cut before it
                first, *runs = part.split(" ")
                known = self.known_runs
                out.append(self.whole(first))
                out += [known[r] for r in runs]
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.ids_bytes(text), "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        places = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        return self.blob[places].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_decode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: bool = False) -> DataFrame:
    """Append n_tokens, the digest of the ids, that of the text decoded from them, and with ids=True the ids.

    As the file's library does without adding special tokens: strings of special tokens inside a text are those
    tokens. A null text is empty: no tokens. Rows stay one to one and need no shuffle; an empty table gives none.
    """

    def compute():
        vocab = vocabulary(path)

        def one(text: bytes):
            packed = vocab.ids_bytes(text.decode("utf-8", "replace"))
            numbers = np.frombuffer(packed, "<u4")
            back = vocab.decode(numbers).encode()
            made = len(numbers), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest()
            return (*made, numbers.astype(np.int32)) if ids else made

        return lambda v: [list(c) for c in zip(*map(one, v[0]), strict=True)]

    return with_results(df, [utf8(f"`{text}`")], RESULTS + (", ids array<int>" if ids else ""), compute, keep)
