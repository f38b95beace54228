"""Quality rules: how much of a text is repeated.

Rolling hashes of n-grams of several lengths, in numpy, tell which n-grams of a text occur in it
before; the verdict rests on the share of characters inside such n-grams and inside repeated lines.
Each text is judged by itself, so a run needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8, with_results

RESULTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, dup_line_share double, dup_ngram_shares array<double>, kept boolean"
)
SYMBOLS = b"#*$%&|<>"
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """Limits of the rules; a text above one of them is rejected.

    In percent of the characters in words, so that whole numbers decide. `ngrams` bounds the characters inside n-grams
    that repeat an earlier one of the text, by n; `lines` those of lines that repeat an earlier line.
    """

    min_words: int = 10
    repeat_percent: int = 20
    ngrams: dict[int, int] = field(default_factory=lambda: {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10})
    lines: int = 20


def mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit value for each small integer, well spread over all bits."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * _STEP
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def repeats(hashes: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks over the windows of n words: equal to any other, and equal to an earlier one. Equal hashes are verified on the words."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    a, b = order[:-1][same], order[1:][same]
    if any((ids[a + i] != ids[b + i]).any() for i in range(n)):
        # two windows share a hash: order by the words themselves
        order = np.lexsort([ids[i : len(ids) - n + 1 + i] for i in reversed(range(n))])
        same = np.logical_and.reduce([ids[order[1:] + i] == ids[order[:-1] + i] for i in range(n)])
    later, any_other = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    later[order[1:][same]] = True
    any_other[order[1:][same]] = True
    any_other[order[:-1][same]] = True
    return any_other, later


def covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Words inside the windows of n words that begin where `starts` is set."""
    edge = np.zeros(len(starts) + n, np.int32)
    edge[: len(starts)] += starts
    edge[n:] -= starts
    return np.cumsum(edge)[:-1] > 0


def judge(text: bytes, limits: Limits) -> tuple:
    words = text.split()
    flat = np.frombuffer(text, np.uint8)
    n_words = len(words)
    blanks = int(np.count_nonzero((flat == 32) | ((flat >= 9) & (flat <= 13))))
    word_chars = int(np.count_nonzero((flat & 0xC0) != 0x80)) - blanks
    n_symbols = sum(map(text.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))

    n_dup_lines, dup_line_chars, seen = 0, 0, set()
    for line in text.split(b"\n"):
        if line in seen:
            n_dup_lines += 1
            dup_line_chars += len(b"".join(line.split()).decode("utf-8", "replace"))
        elif line and not line.isspace():
            seen.add(line)

    shared = dict.fromkeys(limits.ngrams, 0)
    n_repeat = 0
    if n_words > 5:
        numbers: dict[bytes, int] = {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        x = mixed(ids)
        rolled = x.copy()
        lengths = None
        for n in range(2, min(n_words, max(5, *limits.ngrams)) + 1):
            # the hash of n words from that of the n - 1 before the last
            rolled = rolled[:-1] * _STEP + x[n - 1 :]
            if n < 5 and n not in limits.ngrams:
                continue
            any_other, later = repeats(rolled, ids, n)
            if n == 5:
                n_repeat = int(np.count_nonzero(covered(any_other, 5)))
            if not later.any():
                if n >= 5:
                    break  # longer n-grams can't repeat either
                continue
            if n in limits.ngrams:
                if lengths is None:
                    lengths = np.array([len(w.decode("utf-8", "replace")) for w in words], np.int64)
                shared[n] = int(lengths[covered(later, n)].sum())
    base_failed = n_words < limits.min_words or 100 * n_repeat > limits.repeat_percent * n_words
    fits = all(100 * shared[n] <= most * word_chars for n, most in limits.ngrams.items())
    kept = not base_failed and 100 * dup_line_chars <= limits.lines * word_chars and fits
    share = lambda part: part / word_chars if word_chars else 0.0
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, share(dup_line_chars), [share(x) for x in shared.values()], kept


def repetition_quality(df: DataFrame, text: str = "text", limits: Limits | None = None, keep: list[str] | None = None) -> DataFrame:
    """Append the counts, the shares and the verdict `kept` to each row.

    Words are runs of anything but ASCII white space. n_dup_lines counts the lines (cut at \\n) with a
    word that equal an earlier line; n_repeat_words the words inside 5-word windows that occur twice or
    more. A null text has no words and so fails for their number, as an empty one does. Rows stay one
    to one, repeated rows too; columns that have a result's name give way to it. An empty table gives none.
    """
    limits = limits or Limits()
    return with_results(df, [utf8(text)], RESULTS, lambda: lambda v: [list(c) for c in zip(*(judge(t, limits) for t in v[0]), strict=True)], keep)


def keep_quality(df: DataFrame, text: str = "text", limits: Limits | None = None) -> DataFrame:
    """The rows that the rules keep, with their own columns."""
    from .common import fresh

    verdict = fresh(df, "verdict")
    judged = with_results(df, [utf8(text)], f"{verdict} boolean", lambda: lambda v: [[judge(t, limits or Limits())[-1] for t in v[0]]])
    return judged.filter(F.col(verdict)).drop(verdict)
