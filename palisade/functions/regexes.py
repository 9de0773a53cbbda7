"""Rule patterns are written in ECMAScript syntax; Spark matches with Java's engine.

to_java keeps the meaning where the two differ: a bracket inside a class, the word boundary (ASCII),
white space, the end anchor and the dot. to_re2 gives DuckDB's engine the same pattern, or None where
it has no counterpart (look-around).
"""

from __future__ import annotations

import re
import string
from typing import NamedTuple

from pyspark.sql import Column

from palisade.functions.literals import heads

# each by itself: Java looks such a class up in a table, and tries ranges one by one
_WORD = string.digits + string.ascii_letters + "_"
BOUNDARY = f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"
SPACES = r"\t\n\x0B\f\r\x20\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: The same characters as they are.
SPACE_CHARS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_LETTER = re.compile(r"[0-9A-Za-z_]")


def _group(s: str) -> tuple[list[str], int] | None:
    """The alternatives of the plain group that s begins with, and where it ends; None if there is none."""
    if not s.startswith("(") or s.startswith("(?") and not s.startswith("(?:"):
        return None
    depth, out, i = 0, [], 3 if s.startswith("(?:") else 1
    begin = i
    while i < len(s):
        if s[i] == "\\":
            i += 1
        elif s[i] == "[":
            i = s.index("]", i + 2)
        elif s[i] == "(":
            depth += 1
        elif s[i] == ")" and depth:
            depth -= 1
        elif s[i] in "|)" and not depth:
            out.append(s[begin:i])
            begin = i + 1
            if s[i] == ")":
                return out, i + 1
        i += 1
    return None


def _starts(s: str) -> bool:
    """Whether what s matches surely begins with a word character, as far as its first token tells."""
    if found := _group(s):
        return s[found[1] : found[1] + 1] not in ("?", "*", "{") and all(map(_starts, found[0]))
    return bool(_LETTER.match(s)) and s[1:2] not in ("?", "*", "{")


def _ends(s: str) -> bool:
    """Whether what s matches surely ends with a word character, as far as its last token tells."""
    if s.endswith(")"):
        whole = (g[0] for i, c in enumerate(s) if c == "(" and (i == 0 or s[i - 1] != "\\") and (g := _group(s[i:])) and g[1] == len(s) - i)
        return all(map(_ends, next(whole, [""])))
    if s.endswith("?"):
        return bool(_LETTER.match(s[-2:-1])) and _ends(s[:-1]) and _ends(s[:-2])
    return bool(_LETTER.match(s[-1:])) and s[-2:-1] != "\\"


def _boundary(s: str, i: int) -> str:
    """The word boundary behind which s goes on at i: one look-around where a neighbour is known to be a word character."""
    if _starts(s[i:]):
        # where one character is known to come, it is looked at first: at most places it is another
        return (f"(?={s[i]})" if _LETTER.match(s[i:]) else "") + f"(?<![{_WORD}])"
    return f"(?![{_WORD}])" if _ends(s[: i - 2]) else BOUNDARY


class P(NamedTuple):
    """A pattern; case tells whether letters' case counts, lines whether ^ also begins each line."""

    regex: str
    case: bool = False
    lines: bool = False


def to_java(p: P) -> str:
    return _flags(p) + _body(p)


def _flags(p: P) -> str:
    flags = ("" if p.case else "i") + ("m" if p.lines else "")
    return f"(?{flags})" if flags else ""


def _body(p: P) -> str:
    out, i, inside = [], 0, False
    s = p.regex
    while i < len(s):
        c = s[i]
        if c == "\\":
            pair = s[i : i + 2]
            i += 2
            if pair == r"\b" and not inside:
                out.append(_boundary(s, i))
            elif pair == r"\s":
                out.append(SPACES if inside else f"[{SPACES}]")
            elif pair == r"\S":
                out.append(f"[^{SPACES}]")
            else:
                out.append(pair)
            continue
        if inside:
            if c == "]":
                inside = False
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            inside = True
            out.append(c)
            if s[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        elif c == ".":
            out.append(r"[^\n\r\u2028\u2029]")
        elif c == "$":
            out.append(r"\z")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def to_search(p: P) -> str:
    """to_java for a search: at places where no match can begin, a look at one or two characters, each in a table, is all that is tried."""
    classes = "".join(f"[{''.join(c if c.isalnum() else f'\\x{ord(c):02X}' for c in own)}]" for own in heads(p.regex, p.case))
    return _flags(p) + (f"(?={classes})(?:{_body(p)})" if classes else _body(p))


def to_re2(p: P) -> str | None:
    if re.search(r"\(\?[=!<]", p.regex) or r"\u" in p.regex:
        return None
    flags = ("" if p.case else "i") + ("m" if p.lines else "")
    return (f"(?{flags})" if flags else "") + p.regex.replace(r"\`", "`").replace(r"\/", "/")


def has(col: Column, p: P | str) -> Column:
    return col.rlike(to_search(p if isinstance(p, P) else P(p)))
