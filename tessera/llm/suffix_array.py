"""Suffix arrays by induced sorting, and permuted longest common prefixes, in numpy.

The first level, over bytes, is induced a bucket at a time with array operations; the levels below it,
over names of leftmost-smaller (LMS) substrings, are induced by plain loops.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successor (S); the last symbol must be the unique least one."""
    n = len(text)
    up = np.empty(n, np.int8)
    up[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
    up[-1] = 1
    # equal neighbours take the type of the next change
    at = np.where(up != 0, np.arange(n), n)
    return up[np.minimum.accumulate(at[::-1])[::-1]] > 0


def leftmost(is_s: np.ndarray) -> np.ndarray:
    """Positions of S suffixes after an L suffix."""
    return np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1


def _induce(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix order that follows from `seeds` (LMS positions, ordered within each first symbol)."""
    n, symbols = len(text), len(ends)
    starts = np.concatenate([[0], ends[:-1]])
    order = np.full(n, -1, np.int32)
    seed_symbols = text[seeds]
    by_symbol = seeds[np.argsort(seed_symbols, kind="stable")]
    seed_ends = np.cumsum(np.bincount(seed_symbols, minlength=symbols))
    heads, tails = starts.copy(), ends.copy()

    def put(suffixes: np.ndarray, pointers: np.ndarray, want_s: bool) -> None:
        before = suffixes[suffixes > 0] - 1
        before = before[is_s[before] == want_s]
        if not len(before):
            return
        first = text[before]
        grouped = np.argsort(first, kind="stable")
        first, before = first[grouped], before[grouped]
        counts = np.bincount(first, minlength=symbols)
        rank = np.arange(len(first)) - (np.cumsum(counts) - counts)[first]
        if want_s:
            order[pointers[first] - 1 - rank] = before
            pointers -= counts
        else:
            order[pointers[first] + rank] = before
            pointers += counts

    used = np.flatnonzero(ends > starts).tolist()
    for c in used:
        done = starts[c]
        while done < heads[c]:
            part = order[done : heads[c]]
            done = heads[c]
            put(part, heads, False)
        put(by_symbol[(seed_ends[c - 1] if c else 0) : seed_ends[c]], heads, False)
    order[0] = n - 1
    tails[0] = 0
    for c in reversed(used):
        done = ends[c]
        while tails[c] < done:
            part = order[tails[c] : done][::-1]
            done = tails[c]
            put(part, tails, True)
        put(order[starts[c] : heads[c]][::-1], tails, True)
    return order


def _names(text: np.ndarray, lms: np.ndarray, by_rank: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order: equal ones alike, in their order; and how many there are."""
    n = len(text)
    length = np.zeros(n, np.int32)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b, size = by_rank[:-1], by_rank[1:], length[by_rank[:-1]]
    same = size == length[by_rank[1:]]
    a, b, size = a[same], b[same], size[same]
    if len(a):
        first = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(first, size)
        equal = text[np.repeat(a, size) + step] == text[np.repeat(b, size) + step]
        same[same] = np.logical_and.reduceat(equal, first)
    name = np.empty(n, np.int32)
    name[by_rank] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms], int(np.count_nonzero(~same)) + 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence of small non-negative integers with a unique 0 at its end."""
    is_s = classify(text)
    lms = leftmost(is_s)
    ends = np.cumsum(np.bincount(text))
    if not len(lms):  # a decreasing sequence
        return np.arange(len(text) - 1, -1, -1, dtype=np.int32)
    order = _induce(text, is_s, lms, ends)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    by_rank = order[is_lms[order]]
    names, n = _names(text, lms, by_rank)
    if n < len(lms):
        by_rank = lms[_by_loops(names.tolist(), n)]
    return _induce(text, is_s, by_rank, ends)


def _by_loops(text: list[int], symbols: int) -> list[int]:
    """The same for names, whose buckets are too many for array operations on each."""
    n = len(text)
    is_s = bytearray(n)
    is_s[n - 1] = 1
    after, flag = text[n - 1], 1
    for i in range(n - 2, -1, -1):
        here = text[i]
        if here != after:
            flag = 1 if here < after else 0
        is_s[i] = flag
        after = here
    lms = [i for i in range(1, n) if is_s[i] and not is_s[i - 1]]
    ends = np.cumsum(np.bincount(text, minlength=symbols))
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    ends = ends.tolist()

    def induce(seeds: list[int]) -> list[int]:
        order = [-1] * n
        place = ends.copy()
        for i in reversed(seeds):
            c = text[i]
            place[c] -= 1
            order[place[c]] = i
        place = starts.copy()
        for i in order:
            if i > 0 and not is_s[i - 1]:
                c = text[i - 1]
                order[place[c]] = i - 1
                place[c] += 1
        place = ends.copy()
        for k in range(n - 1, -1, -1):
            i = order[k]
            if i > 0 and is_s[i - 1]:
                c = text[i - 1]
                place[c] -= 1
                order[place[c]] = i - 1
        return order

    if not lms:
        return list(range(n - 1, -1, -1))
    order = induce(lms)
    by_rank = [i for i in order if i > 0 and is_s[i] and not is_s[i - 1]]
    names, count = _names(np.array(text), np.array(lms), np.array(by_rank))
    if count < len(lms):
        by_rank = [lms[k] for k in _by_loops(names.tolist(), count)]
    return induce(by_rank)


def permuted_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the one before it in the order (-1 for the first) and the length of their common prefix.

    A suffix whose symbol before equals that of its neighbour shares one less than the suffix before it in the text;
    so only the others, the irreducible ones, are compared, and the rest follow.
    """
    n = len(text)
    near = np.empty(n, np.int64)
    near[order[0]] = -1
    near[order[1:]] = order[:-1]
    at = np.arange(n)
    reducible = (at > 0) & (near > 0)
    reducible[reducible] = text[at[reducible] - 1] == text[near[reducible] - 1]
    # after a neighbour that begins the text, or none, nothing follows from the suffix before
    todo = np.flatnonzero(~reducible & (near >= 0))
    shared = np.zeros(n, np.int64)
    width = 8
    open_ = todo
    while len(open_):
        i, j = open_ + shared[open_], near[open_] + shared[open_]
        room = n - np.maximum(i, j)
        step = np.arange(width)
        inside = step < room[:, None]
        equal = inside & (text[np.minimum(i[:, None] + step, n - 1)] == text[np.minimum(j[:, None] + step, n - 1)])
        run = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
        shared[open_] += run
        open_ = open_[run == width]
        width = min(64, width * 2)
    # shared + position never falls along a reducible run, so the run's first value carries on
    lead = np.where(reducible, -1, at)
    lead = np.maximum.accumulate(lead)
    shared = np.maximum(shared[lead] - (at - lead), 0)
    return near, np.where(near >= 0, shared, 0)


def repeated_starts(text: np.ndarray, length: int) -> np.ndarray:
    """Which positions begin a string of `length` symbols that begins at another position too."""
    order = suffix_array(text)
    near, shared = permuted_prefixes(text, order)
    long_ = shared >= length
    out = long_.copy()
    out[near[long_]] = True
    return out
