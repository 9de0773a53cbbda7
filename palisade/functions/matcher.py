"""Which of many items a text can match at all, told in one pass over it.

An item has groups of strings, of each of which the text must hold one. All strings of all items go into one
Aho-Corasick automaton; what it meets in a text gives a bit for each item. A text goes to Python once, by Arrow,
whatever the number of items."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of an item's word.
BITS = 63
#: Sets of met strings whose bits a worker remembers; beyond it, it begins anew.
KNOWN = 4096
#: Strings this short come up all the time: they are looked for one by one.
SHORT = 2

Groups = tuple[tuple[str, ...], ...]


class Matcher:
    """held(text) has, for each list of items, numbers whose bits tell which of them the text can match."""

    def __init__(self, lists: tuple[tuple[Groups, ...], ...]):
        numbers: dict[tuple[str, ...], int] = {}
        self.items = [[sum({1 << numbers.setdefault(g, len(numbers)) for g in groups}) for groups in items] for items in lists]
        of: dict[str, int] = {}
        for group, k in numbers.items():
            for word in group:
                of[word] = of.get(word, 0) | 1 << k
        self.short = [(w, m) for w, m in of.items() if len(w) <= SHORT]
        self.long = ahocorasick.Automaton()
        for w, m in of.items():
            if len(w) > SHORT:
                self.long.add_word(w, m)
        if len(self.long):
            self.long.make_automaton()
        self.known: dict[int, list[int]] = {}

    def held(self, text: str) -> list[int]:
        met = 0
        if len(self.long):
            for m in {m for _, m in self.long.iter(text)}:
                met |= m
        for w, m in self.short:
            if m & ~met and w in text:
                met |= m
        if met not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[met] = [sum(1 << i for i, need in enumerate(items) if need & met == need) for items in self.items]
        return self.known[met]


@functools.lru_cache(maxsize=8)
def _built(lists: tuple[tuple[Groups, ...], ...]) -> Matcher:
    return Matcher(lists)


def held(text: Column, lists: tuple[tuple[Groups, ...], ...]) -> Column:
    """array<bigint>: for each list of at most 63 items a number whose bit i tells whether text can match item i."""
    if any(len(items) > BITS for items in lists):
        raise ValueError(f"a list has at most {BITS} items")

    # by Arrow, a text at a time: a worker holds a batch as it came and one text, not every text of the batch as an object
    @F.arrow_udf("array<bigint>")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = _built(lists)
        for texts in batches:
            yield pa.array((matcher.held(t.as_py()) if t.is_valid else [0] * len(lists) for t in texts), pa.list_(pa.int64()), size=len(texts))

    return told(text)
