"""A run-length index of a collection of strings: what of each string occurs elsewhere.

`RunIndex` sorts the suffixes of the strings, takes their Burrows-Wheeler transform and keeps
it by runs, with the suffix array sampled at run starts and run ends only.  Longest-match
lengths are needed at those samples alone: between them, as the text is streamed, the match of a
position is that of the position before it less one (rows within a run keep their neighbours
when both are extended by the run's letter).  The more repetitive the strings, the fewer samples.
A string that occurs several times is held once: its copies' rows are neighbours and make runs
longer, not more.

Strings are of bytes other than 0xFF (as UTF-8 is) and end with separators that match nothing,
so no match crosses from one string to the next.
"""

from __future__ import annotations

import numpy as np

from mosaicore.llm.bytestext import ragged

U64 = np.uint64


def packed_words(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next 8 letters of each place as a number, zero from a separator on; whether none of them is one."""
    n = len(s)
    wide = np.concatenate([s, np.zeros(8, s.dtype)])
    words, alive = np.zeros(n, U64), np.ones(n, bool)
    for k in range(8):
        letter = wide[k : k + n]
        alive &= letter != 0
        words = words << U64(8) | np.where(alive, letter, 0).astype(U64)
    return words, alive


def suffix_array(words: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """The suffixes in order; separators differ, in the order of their places.

    Prefix doubling from 8 letters on; places whose rank is settled take no further part.
    """
    n = len(words)
    order = np.argsort(words)
    ends = np.flatnonzero(~alive[order])  # suffixes that end within 8 letters share no word with others
    own = np.sort(order[ends])
    order[ends] = own[np.argsort(words[own], kind="stable")]
    head = np.ones(n, bool)  # starts of groups of equal suffixes so far
    if n > 1:
        w = words[order]
        head[1:] = (w[1:] != w[:-1]) | ~alive[order[1:]]
    step = 8
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    while True:
        start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[order] = start
        open_ = ~head
        open_[:-1] |= ~head[1:]
        where = np.flatnonzero(open_)
        if not len(where):
            return order
        own = order[where]
        first = start[where]
        second = rank[np.minimum(own + step, n)]
        by = np.lexsort((second, first)) if n >= 1 << 31 else np.argsort(first << 32 | second + 1)
        own, first, second = own[by], first[by], second[by]
        order[where] = own
        head[where[1:]] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        step *= 2


class RunIndex:
    """data: distinct strings' bytes, one after the other; lengths: of each; counts: how often each occurs (once)."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, counts: np.ndarray | None = None):
        self.lengths, self.counts = lengths, counts
        self.starts = np.cumsum(lengths + 1) - (lengths + 1)  # places in the text with separators
        self.text = np.zeros(int((lengths + 1).sum()), np.uint8)
        self.text[ragged(self.starts, lengths)] = data + np.uint8(1)
        self.words, self.alive = packed_words(self.text)
        order = suffix_array(self.words, self.alive)
        before = self.text[order - 1]
        before[order == 0] = 0
        new = np.ones(len(order), bool)
        new[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.run_start = np.flatnonzero(new)  # rows
        self.run_letter = before[self.run_start]
        run_end = np.append(self.run_start[1:], len(order)) - 1
        # samples at run ends: a suffix and its neighbour in the run next to it
        self.first, self.above = order[self.run_start[1:]], order[self.run_start[1:] - 1]
        self.last, self.below = order[run_end[:-1]], order[run_end[:-1] + 1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes, compared 8 letters at a time."""
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        n = len(self.text)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            inside = (x < n) & (y < n)
            live, x, y = live[inside], x[inside], y[inside]
            same = (self.words[x] == self.words[y]) & self.alive[x] & self.alive[y]
            rest, x, y = live[~same], x[~same], y[~same]
            differ = self.words[x] ^ self.words[y]
            equal, on = np.zeros(len(rest), np.int64), np.ones(len(rest), bool)
            for k in range(8):
                shift = U64(56 - 8 * k)
                on &= (differ >> shift & U64(255) == 0) & (self.words[x] >> shift & U64(255) != 0)
                equal += on
            out[rest] += equal
            live = live[same]
            out[live] += 8
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each place of the text, the length of the longest match that starts elsewhere."""
        n = len(self.text)
        best = np.zeros(n, np.int64)
        place = np.arange(n)
        for at, near in ((self.first, self.above), (self.last, self.below)):
            reach = np.zeros(n, np.int64)
            reach[at] = at + self.common(at, near)
            np.maximum(best, np.maximum.accumulate(reach) - place, out=best)
        if self.counts is not None:  # a suffix of a string that occurs again has a neighbour to the string's end
            again = self.counts > 1
            own = ragged(self.starts[again], self.lengths[again])
            best[own] = np.repeat((self.starts + self.lengths)[again], self.lengths[again]) - own
        return best

    def long_matches(self, least: int) -> list[list[tuple[int, int]]]:
        """For each string the runs [first, last] of starts whose next `least` bytes also start elsewhere."""
        long = self.matching_statistics() >= least
        edge = np.flatnonzero(np.diff(np.concatenate([[0], long.astype(np.int8), [0]])))
        out: list[list[tuple[int, int]]] = [[] for _ in self.lengths]
        owner = np.searchsorted(self.starts, edge[::2], side="right") - 1
        for k, a, b in zip(owner.tolist(), edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            base = int(self.starts[k])
            out[k].append((a - base, b - 1 - base))
        return out
