"""A run-length index over a collection of short strings: run-compressed BWT, sampled run ends, matching statistics.

The suffixes of all strings are sorted (a string's end is smaller than any byte, and ends are ordered as the
strings are), and the Burrows-Wheeler transform is read off that order. Only its runs are kept: a letter and a
first row for each, and two samples, the text positions of the suffixes at the run's head and at the end of the run before,
with the length of their common prefix. Suffix order, inverse and ranks are given up. What is asked of them comes from the runs:

- lf(row) is the row of the suffix one byte to the left: letters' counts and a search among the run heads.
- before(position) is the suffix one row above, by the sample at or left of the position: within a run both move
  left together.
- statistics() streams, in text order, the match of each suffix with the one above: a sample's length less one byte
  for each step to the right, up to the next sample. In repetitive collections there are few runs, and so few samples.
- repeated(length) follows the suffixes above while they match so far, to the first of such a group of rows, and
  tells all but the earliest of each group.
"""

from __future__ import annotations

import numpy as np

_STEP = 7  # symbols of 9 bits in the first sort key


class RunLengthIndex:
    def __init__(self, strings: list[bytes]):
        """No string may be empty."""
        size = np.array([len(s) for s in strings], np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        symbols = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        self.n = n = len(symbols)
        left = np.repeat(self.end, size) - np.arange(n)  # bytes up to the string's end
        levels = _sorted_levels(symbols, left, int(size.max()))
        order = np.argsort(levels[-1][1], kind="stable")
        # a string's first suffix has an end before it, which equals nothing
        letters = np.where(left == np.repeat(size, size), 0, np.concatenate([[0], symbols[:-1]]))[order]
        head = np.ones(n, bool)
        head[1:] = (letters[1:] != letters[:-1]) | (letters[1:] == 0)
        self.heads = np.flatnonzero(head)
        self.letters = letters[self.heads]
        above = order[np.maximum(self.heads - 1, 0)]
        common = _common(levels, symbols, left, order[self.heads], above)
        common[0] = 0
        # samples in text order
        at = np.argsort(order[self.heads])
        self.sample, self.above, self.common = order[self.heads][at], above[at], common[at]
        # for lf(): rows above of the run's own letter
        length = np.diff(np.append(self.heads, n))
        by_letter = np.lexsort((self.heads, self.letters))
        count = np.zeros(len(self.heads), np.int64)
        own = length[by_letter]
        total = np.cumsum(own) - own
        first = np.searchsorted(self.letters[by_letter], self.letters[by_letter])
        count[by_letter] = total - total[first]
        self.rank = count
        starts = np.bincount(symbols, minlength=258)
        # a string's last byte stands before no row; as a suffix it comes first among those with its letter
        self.smaller = np.cumsum(starts) - starts + np.bincount(symbols[self.end - 1], minlength=258)

    def lf(self, rows: np.ndarray) -> np.ndarray:
        """For rows whose suffix has a byte before it, the row of the suffix with that byte."""
        run = np.searchsorted(self.heads, rows, side="right") - 1
        return self.smaller[self.letters[run]] + self.rank[run] + rows - self.heads[run]

    def letter(self, rows: np.ndarray) -> np.ndarray:
        """The byte before each row's suffix, plus one; 0 at a string's start."""
        return self.letters[np.searchsorted(self.heads, rows, side="right") - 1]

    def before(self, positions: np.ndarray) -> np.ndarray:
        """The text position of the suffix one row above; of the first row's, itself."""
        i = np.searchsorted(self.sample, positions, side="right") - 1
        return self.above[i] + positions - self.sample[i]

    def statistics(self) -> np.ndarray:
        """For each text position the match of its suffix with the one above, streamed from the samples."""
        reach = np.zeros(self.n, np.int64)
        reach[self.sample] = self.sample + self.common
        return np.maximum.accumulate(reach) - np.arange(self.n)

    def repeated(self, length: int) -> np.ndarray:
        """Positions at which a match of `length` begins that also begins at a smaller position."""
        joined = np.flatnonzero(self.statistics() >= length)
        if not len(joined):
            return joined
        above = self.before(joined)
        members = np.union1d(joined, above)
        top = np.arange(len(members))
        top[np.searchsorted(members, joined)] = np.searchsorted(members, above)
        while True:  # jumps double
            further = top[top]
            if (further == top).all():
                break
            top = further
        least = np.full(len(members), self.n)
        np.minimum.at(least, top, members)
        return members[members != least[top]]


def _sorted_levels(symbols: np.ndarray, left: np.ndarray, longest: int) -> list[tuple[int, np.ndarray]]:
    """(h, rank by the first h symbols) for doubling h, up to the longest string."""
    n = len(left)
    key = np.zeros(n, np.int64)
    for j in range(_STEP):
        part = np.zeros(n, np.int64)
        part[: max(0, n - j)] = symbols[j:]
        key = key << 9 | np.where(left > j, part, 0)
    h, out = _STEP, []
    while True:
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], key[order][1:] != key[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step) + 1
        out.append((h, rank))
        if h >= longest or rank[order[-1]] == n:
            return out
        after = np.zeros(n, np.int64)
        after[: max(0, n - h)] = rank[h:]
        key = rank * (n + 1) + np.where(left > h, after, 0)
        h *= 2


def _common(levels, symbols: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, by the doubling ranks, then symbol by symbol."""
    room = np.minimum(left[a], left[b])
    at = np.zeros(len(a), np.int64)
    take = lambda x, p: x[np.minimum(p, len(x) - 1)]
    for h, rank in reversed(levels):
        for _ in range(2):  # a level may fit twice where the one above did not fit the room
            ok = (at + h <= room) & (take(rank, a + at) == take(rank, b + at))
            at[ok] += h
    for _ in range(_STEP):
        ok = (at < room) & (take(symbols, a + at) == take(symbols, b + at))
        at[ok] += 1
    return at
