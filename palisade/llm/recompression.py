"""A run-length grammar of a sequence by recompression, and extension queries on it.

Rounds alternate: blocks of one repeated symbol become one symbol, then symbols are dealt to two
sides and every neighbouring (left, right) pair becomes one symbol. Equal stretches are compressed
alike but for a few symbols at their ends, so the longest common extension of two places climbs to
symbols that cover much of it and comes down where they differ: about as many steps as levels.
Symbols are numbers of exact (symbol, count) and (left, right) keys, not fingerprints.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Rounds after which the rest is left as it is; queries stay exact, each level only shortens them.
MOST_ROUNDS = 48


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Grammar:
    """Grammar of `symbols`, whose first and last symbol occur once in it.

    The levels lie one after the other in flat arrays; each ends in an entry that stands for its end.
    sym: symbol, unlike on unlike levels; start: place in the sequence; up: the entry that covers it one
    level higher, or -1; down: its first entry one level lower; block: whether the step up joined equal symbols."""

    def __init__(self, symbols: np.ndarray):
        sym, start, down = symbols.astype(np.int64), np.arange(len(symbols) + 1, dtype=np.int64), np.full(len(symbols) + 1, -1, np.int64)
        syms, starts, downs, ups, blocks, at = [], [], [], [], [], 0
        following, quiet = int(sym.max()) + 1 if len(sym) else 0, 0
        for step in range(2 * MOST_ROUNDS):
            block = step % 2 == 0
            heads = self._block_heads(sym) if block else self._pair_heads(sym, step)
            if len(heads) == len(sym):
                quiet += 1
                if quiet > 3:  # neither blocks nor pairs are left
                    break
                continue
            quiet = 0
            up = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(sym))))
            self._keep(syms, starts, downs, sym, start, down)
            ups.append(np.append(up, len(heads)) + at + len(sym) + 1)
            blocks.append(np.full(len(sym) + 1, block))
            down = np.append(heads, len(sym)) + at
            at += len(sym) + 1
            start = start[np.append(heads, len(sym))]
            sym, following = self._named(sym, heads, block, following)
        self._keep(syms, starts, downs, sym, start, down)
        ups.append(np.full(len(sym) + 1, -1))
        blocks.append(np.zeros(len(sym) + 1, bool))
        self.levels = len(syms)
        self.sym, self.start, self.down, self.up, self.block = (np.concatenate(x) for x in (syms, starts, downs, ups, blocks))

    @staticmethod
    def _keep(syms, starts, downs, sym, start, down):
        syms.append(np.append(sym, -1))
        starts.append(start)
        downs.append(down)

    @staticmethod
    def _block_heads(sym: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.append(True, sym[1:] != sym[:-1])) if len(sym) else np.zeros(0, np.int64)

    @staticmethod
    def _pair_heads(sym: np.ndarray, step: int) -> np.ndarray:
        """Of two ways to deal symbols to the sides, the one that joins more pairs."""
        best = None
        for seed in (2 * step + 1, 2 * step + 2):
            right = (_mix(sym, seed) >> np.uint64(33)) & np.uint64(1) == 1
            second = np.append(False, ~right[:-1] & right[1:])
            if best is None or second.sum() > best.sum():
                best = second
        return np.flatnonzero(~best)

    @staticmethod
    def _named(sym: np.ndarray, heads: np.ndarray, block: bool, following: int) -> tuple[np.ndarray, int]:
        """The symbols of the next level. One that stands for a single symbol is renamed too, so that levels share no symbol."""
        size = np.diff(np.append(heads, len(sym)))
        second = size if block else np.where(size > 1, sym[np.minimum(heads + 1, len(sym) - 1)] + 1, 0)
        codes = pd.factorize(sym[heads] * (int(second.max()) + 1) + second)[0]
        return codes + following, following + len(heads)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a on equal those from b on; a and b differ."""
        return self._extend(a, b, True)

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols up to a, itself included, equal those up to b."""
        return self._extend(a, b, False)

    def _extend(self, a: np.ndarray, b: np.ndarray, ahead: bool) -> np.ndarray:
        sym, start, down, up, block = self.sym, self.start, self.down, self.up, self.block
        out, open_, x, y = np.zeros(len(a), np.int64), np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        while len(open_):
            same = sym[x] == sym[y]
            low = down[x] < 0
            over = ~same & low
            if over.any():
                out[open_[over]] = start[x[over]] - a[open_[over]] if ahead else a[open_[over]] - start[x[over]]
                keep = ~over
                open_, x, y, same = open_[keep], x[keep], y[keep], same[keep]
            if not len(open_):
                break
            # unlike symbols: compare what they stand for
            i = np.flatnonzero(~same)
            x[i], y[i] = (down[x[i]], down[y[i]]) if ahead else (down[x[i] + 1] - 1, down[y[i] + 1] - 1)
            # like symbols: climb where both begin (or end) like entries, else step over them
            i = np.flatnonzero(same)
            px, py = up[x[i]], up[y[i]]
            top = px < 0
            qx, qy = np.where(top, 0, px), np.where(top, 0, py)
            edge_x, edge_y = (down[qx], down[qy]) if ahead else (down[qx + 1] - 1, down[qy + 1] - 1)
            climbs = ~top & (edge_x == x[i]) & (edge_y == y[i]) & (sym[qx] == sym[qy])
            end_x, end_y = (down[qx + 1], down[qy + 1]) if ahead else (down[qx] - 1, down[qy] - 1)
            over = np.where(~top & block[x[i]], np.minimum(np.abs(end_x - x[i]), np.abs(end_y - y[i])), 1)
            step = over if ahead else -over
            x[i], y[i] = np.where(climbs, px, x[i] + step), np.where(climbs, py, y[i] + step)
        return out
