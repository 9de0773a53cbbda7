"""Strings that every match of a pattern must hold, told from the pattern's syntax.

A plain substring search is many times cheaper than an expression, so a rule looks for these first. What is
told may be too little, never too much: a text without any of them has no match.
"""

from __future__ import annotations

import functools
import re._constants as sre
import re._parser as sre_parser

#: Alternatives kept while strings are joined, and characters of a class that are taken as alternatives.
MOST, MOST_CHARS = 48, 4
#: How many characters of a match's head are told, and of how many beginnings.
HEAD, MOST_HEADS = 2, 400
_DIGITS = frozenset("0123456789")
_WORDS = _DIGITS | frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")


def _score(words: frozenset[str]) -> float:
    """Long strings and few of them are best."""
    return min(map(len, words)) - len(words) / 12


def _sequence(items) -> tuple[set[str] | None, frozenset[str] | None]:
    """The exact strings of items, or None; and the best set of strings one of which each match holds."""
    exact: set[str] | None = {""}
    best: frozenset[str] | None = None
    whole = True

    def offer(words):
        nonlocal best
        if words and all(words) and (best is None or _score(frozenset(words)) > _score(best)):
            best = frozenset(words)

    for op, arg in items:
        own, need = _one(op, arg)
        if own is not None and len(exact) * len(own) <= MOST:
            exact = {a + b for a in exact for b in own}
            continue
        offer(exact)
        offer(need if own is None else own)
        exact, whole = {""}, False
    offer(exact)
    return (exact if whole else None), best


def _one(op, arg) -> tuple[set[str] | None, frozenset[str] | None]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, None
    if op is sre.IN:
        chars = {chr(a).lower() for kind, a in arg if kind is sre.LITERAL}
        exact = len(arg) <= MOST_CHARS and all(kind is sre.LITERAL for kind, _ in arg)
        return (chars, None) if exact else (None, None)
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}, None
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MOST:
            return set().union(*(e for e, _ in parts)), None
        needs = [frozenset(e) if e is not None and all(e) and (n is None or _score(frozenset(e)) >= _score(n)) else n for e, n in parts]
        return None, None if any(n is None for n in needs) else frozenset().union(*needs)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, inner = arg
        exact, need = _sequence(inner)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, None
        if low == 0:
            return None, None
        if low == high == 1:
            return exact, need
        return None, need if exact is None else frozenset(exact) if all(exact) else None
    return None, None


@functools.cache
def required(regex: str) -> tuple[str, ...]:
    """Lower-case strings, one of which every text with a match holds in lower case; empty if none can be told."""
    try:
        tree = sre_parser.parse(regex)
    except Exception:  # syntax of another dialect
        return ()
    exact, best = _sequence(tree)
    found = best if best is not None else frozenset(exact or ())
    # a character whose lower case is not itself alone might not be found as it stands
    if not found or not all(found) or not all(x.isascii() for x in found):
        return ()
    # of strings within one another the shorter says all
    return tuple(sorted(x for x in found if not any(y != x and y in x for y in found)))


def _chars(op, arg) -> frozenset[str] | None:
    """The ASCII characters that an item of one character takes; None if there are others or they cannot be told."""
    if op is sre.LITERAL:
        return frozenset(chr(arg)) if arg < 128 else None
    if op is sre.RANGE:
        return frozenset(map(chr, range(arg[0], arg[1] + 1))) if arg[1] < 128 else None
    if op is sre.CATEGORY:
        return {sre.CATEGORY_DIGIT: _DIGITS, sre.CATEGORY_WORD: _WORDS}.get(arg)
    if op is sre.IN:
        own = [_chars(*x) for x in arg]
        return None if None in own else frozenset().union(*own)
    return None


def _joined(a: set[tuple], b: set[tuple]) -> set[tuple]:
    out = {x if len(x) == HEAD else (x + y)[:HEAD] for x in a for y in b}
    return out if len(out) <= MOST_HEADS else {(None,) * HEAD}


def _begins(items) -> set[tuple]:
    """How matches of items begin: for each place up to HEAD its characters, None if any; shorter where a match is."""
    out: set[tuple] = {()}
    for op, arg in items:
        if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        if op is sre.SUBPATTERN and not arg[1] and not arg[2]:
            own = _begins(arg[3])
        elif op is sre.BRANCH:
            own = set().union(*map(_begins, arg[1]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            once = _begins(arg[2])
            own = once if arg[1] == 1 else once | _joined(once, once)
            own = own | {()} if arg[0] == 0 else own
        elif op in (sre.LITERAL, sre.NOT_LITERAL, sre.IN, sre.ANY):
            own = {(_chars(op, arg),)}
        else:
            own = {(None,) * HEAD}
        out = _joined(out, own)
        if all(len(x) == HEAD for x in out):
            break
    return out


@functools.cache
def heads(regex: str, case: bool) -> tuple[str, ...]:
    """The characters that can stand at the first places of a match, sorted, up to the first place where any can; case: whether letters' case counts."""
    try:
        begins = _begins(sre_parser.parse(regex))
    except Exception:  # syntax of another dialect
        return ()
    out = []
    for i in range(HEAD):
        if any(len(x) <= i or x[i] is None for x in begins):
            break
        own = frozenset().union(*(x[i] for x in begins))
        out.append("".join(sorted(own if case else {c for x in own for c in (x.lower(), x.upper())})))
    return tuple(out)
