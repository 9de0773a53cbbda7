"""Lengths and cuts in UTF-16 units, as column functions: a character above U+FFFF counts as two."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.let import let


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-16BE")


def units(text: Column) -> Column:
    """The length of text in units."""
    return (F.octet_length(_bytes(text)) / 2).cast("int")


def longer(text: Column, n: int) -> Column:
    """Whether text has more than n units; most texts are told by their characters or bytes."""
    return F.when(F.octet_length(text) <= n, False).when(F.length(text) > n, True).otherwise(units(text) > n)


def prefix(text: Column, n: int) -> Column:
    """The first n units of text; a pair of units that the cut would split stays out."""

    def cut(raw):
        head = F.substring(raw, 1, 2 * n)
        split = F.hex(F.substring(head, 2 * n - 1, 1)).between("D8", "DB")
        return F.decode(F.when(split, F.substring(head, 1, 2 * n - 2)).otherwise(head), "UTF-16BE")

    # n characters have n units at least
    return F.when(F.octet_length(text) <= n, text).otherwise(let(_bytes(F.substring(text, 1, n)), cut))


def suffix(text: Column, n: int) -> Column:
    """The last n units of text; a pair of units that the cut would split stays out."""

    def cut(raw):
        tail = F.substring(raw, F.greatest(F.lit(1), F.octet_length(raw) - 2 * n + 1), F.lit(2 * n))
        split = F.hex(F.substring(tail, 1, 1)).between("DC", "DF")
        return F.decode(F.when(split, F.substring(tail, F.lit(3), F.octet_length(tail))).otherwise(tail), "UTF-16BE")

    return F.when(F.octet_length(text) <= n, text).otherwise(let(_bytes(F.substring(text, F.greatest(F.lit(1), F.length(text) - n + 1), F.lit(n))), cut))
