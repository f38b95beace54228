"""License scans: exact phrases, and short notices with bounded errors.

A notice that a text has with at most k edits leaves at least one of k + 1 pieces of it untouched. So
the pieces of every notice are searched for exactly, and where one stands the regex library's
bounded-error matching verifies the notice around it and reports its span and edits.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import lru_cache
from heapq import heappop, heappush
from itertools import accumulate

import regex
from pyspark.sql import DataFrame

from .common import utf8, with_results

RESULTS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "notices array<struct<label:string,first_word:bigint,last_word:bigint,edits:int>>"
)

#: Phrases whose words must stand in a row, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short notices, as words, and their labels; each may have an edit in every 12 characters, 5 at most.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "licensed under the gnu general public license version 3": "gpl-3",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}

#: Upper-case ASCII letters become lower-case, other ASCII characters than letters and digits become blanks.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def edits_allowed(notice: str) -> int:
    return min(5, len(notice) // 12)


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    edits: int
    seeds: tuple[tuple[int, str], ...]
    pattern: regex.Pattern


@lru_cache(1)
def notices() -> tuple[Notice, ...]:
    made = []
    for text, label in NOTICES.items():
        k = edits_allowed(text)
        cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
        seeds = tuple((a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
        made.append(Notice(label, text, k, seeds, regex.compile(f"(?b)(?:{regex.escape(text, literal_spaces=True)}){{e<={k}}}")))
    return tuple(made)


def fuzzy_matches(joined: str) -> list[tuple[Notice, int, int, int]]:
    """(notice, start, end, edits) of matches in words joined by single blanks; those of a notice do not overlap.

    Each seed opens a window as long as the notice with its edits around it. The windows' best matches are taken by their
    edits, then their place; one that overlaps what is taken gives way to the best one in what its window has left. A window
    can overlap few matches, so the time is linear in the seeds.
    """
    found = []
    for notice in notices():
        least, search = len(notice.text) - notice.edits, notice.pattern.search
        windows = set()
        for offset, seed in notice.seeds:
            at = joined.find(seed)
            while at >= 0:
                begin = at - offset - notice.edits
                windows.add((max(0, begin), min(len(joined), begin + len(notice.text) + 2 * notice.edits)))
                at = joined.find(seed, at + 1)
        waiting = []

        def look(lo: int, hi: int, search=search, least=least, waiting=waiting) -> None:
            if hi - lo >= least and (m := search(joined, lo, hi)):
                heappush(waiting, (sum(m.fuzzy_counts), m.start(), m.end(), lo, hi))

        for lo, hi in windows:
            look(lo, hi)
        taken: list[tuple[int, int]] = []  # ascending and apart
        while waiting:
            edits, start, end, lo, hi = heappop(waiting)
            i = bisect_right(taken, (start, end))
            if (i and taken[i - 1][1] > start) or (i < len(taken) and taken[i][0] < end):
                i = max(0, bisect_right(taken, (lo, lo)) - 1)
                while i < len(taken) and taken[i][0] < hi:
                    look(lo, taken[i][0])
                    lo = max(lo, taken[i][1])
                    i += 1
                look(lo, hi)
            else:
                taken.insert(i, (start, end))
                found.append((notice, start, end, edits))
    return found


def scan(text: bytes) -> tuple:
    words = text.translate(_TABLE).split()
    joined = b" ".join(words)
    framed = b" " + joined + b" "
    starts, base, score, places = [], set(), 0.0, None
    for phrase, label in PHRASES.items():
        needle = b" " + phrase.encode() + b" "
        at = framed.find(needle)
        while at >= 0:
            places = places or [0, *accumulate(len(w) + 1 for w in words)]
            starts.append(bisect_left(places, at))
            base.add(label)
            at = framed.find(needle, at + 1)
    if base:
        score = 1.0
    plain = joined.decode("utf-8", "replace")
    spans = []
    matches = fuzzy_matches(plain)
    if matches:
        begins = [0, *accumulate(len(w) + 1 for w in plain.split(" "))]
        word = lambda at: bisect_right(begins, at) - 1
        for notice, a, b, edits in matches:
            spans.append({"label": notice.label, "first_word": word(a), "last_word": word(max(a, b - 1)), "edits": edits})
            score = max(score, 1 - edits / len(notice.text))
    spans.sort(key=lambda s: (s["first_word"], s["last_word"], s["label"]))
    labels = base | {s["label"] for s in spans}
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), score, spans,
    )


def license_scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append the places of the exact phrases, the labels, the notices with their edits, and a score to each row.

    Words are runs of digits, lower-case letters (A-Z lower-cased) and non-ASCII characters, counted from 0. Notices are
    matched on the words joined by blanks, so line ends and punctuation don't count. score is 1 with an exact
    phrase, else 1 less the share of edits of the best notice, else 0. A null text is empty: no words, no labels (empty
    strings). Rows stay one to one and need no shuffle; an empty table gives none.
    """
    return with_results(df, [utf8(f"`{text}`")], RESULTS, lambda: lambda v: [list(c) for c in zip(*map(scan, v[0]), strict=True)], keep)
