"""Globs over paths, and a listing that never opens a folder in which nothing can be wanted.

Known: * ? [a-z] [!a-z] [[:alpha:]], ** over folders, {a,b} also nested, {1..3}, @(a|b) ?(a|b) *(a|b) +(a|b) !(a|b), and a backslash
before a character that stands for itself. Wildcards of an include glob take no leading dot; those of an exclude glob do.
An include glob that begins with ! excludes."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterator

_POSIX = {"alpha": "A-Za-z", "digit": "0-9", "alnum": "A-Za-z0-9", "upper": "A-Z", "lower": "a-z", "word": "A-Za-z0-9_", "xdigit": "0-9A-Fa-f", "space": r"\s"}
_CLOSES = {"{": "}", "(": ")"}


def _end(s: str, i: int) -> int:
    """Where the bracket at i closes, or -1."""
    open_, close, depth = s[i], _CLOSES[s[i]], 0
    while i < len(s):
        if s[i] == "\\":
            i += 1
        elif s[i] == open_:
            depth += 1
        elif s[i] == close:
            depth -= 1
            if not depth:
                return i
        i += 1
    return -1


def _split(s: str, by: str) -> list[str]:
    """s cut at `by` outside of brackets."""
    out, i, begin = [], 0, 0
    while i < len(s):
        if s[i] == "\\":
            i += 1
        elif s[i] in _CLOSES and (j := _end(s, i)) > 0:
            i = j
        elif s[i] == by:
            out.append(s[begin:i])
            begin = i + 1
        i += 1
    return [*out, s[begin:]]


def expanded(glob: str) -> list[str]:
    """The globs without braces that stand for this one."""
    for i, c in enumerate(glob):
        if c == "{" and (not i or glob[i - 1] not in "\\$") and (j := _end(glob, i)) > 0:
            inner = glob[i + 1 : j]
            steps = re.fullmatch(r"(-?\d+)\.\.(-?\d+)", inner)
            parts = _split(inner, ",")
            if steps:
                a, b = map(int, steps.groups())
                parts = [str(k) for k in range(a, b + (1 if b >= a else -1), 1 if b >= a else -1)]
            elif len(parts) < 2:
                continue
            return [x for p in parts for x in expanded(glob[:i] + p + glob[j + 1 :])]
    return [glob]


def _class(s: str, i: int) -> tuple[str, int] | None:
    """The character class at i and where it ends."""
    j = i + 1
    negated = s[j : j + 1] in ("!", "^")
    j += negated
    begin = j
    out = ""
    while j < len(s) and (s[j] != "]" or j == begin):
        named = re.match(r"\[:(\w+):\]", s[j:])
        if named and named[1] in _POSIX:
            out, j = out + _POSIX[named[1]], j + named.end()
        elif s[j] == "-" and j > begin and s[j + 1 : j + 2] != "]":
            out, j = out + "-", j + 1
        else:
            j += s[j] == "\\"
            out, j = out + re.escape(s[j : j + 1]), j + 1
    return (f"[{'^/' if negated else ''}{out}]", j + 1) if j < len(s) and out else None


def _segment(s: str, dots: bool) -> str:
    """One part of a path as an expression."""
    out, i = "", 0
    while i < len(s):
        c = s[i]
        lead = "" if dots or i else r"(?!\.)"
        if c in "@?*+!" and s[i + 1 : i + 2] == "(" and (j := _end(s, i + 1)) > 0:
            any_of = "(?:" + "|".join(_segment(p, True) for p in _split(s[i + 2 : j], "|")) + ")"
            if c == "!":
                return out + lead + f"(?!{any_of}{_segment(s[j + 1 :], True)}(?:/|$))[^/]*" + _segment(s[j + 1 :], True)
            out, i = out + lead + any_of + {"@": ""}.get(c, c), j + 1
        elif c == "*":
            while s[i : i + 1] == "*":
                i += 1
            out += lead + "[^/]*"
        elif c == "?":
            out, i = out + lead + "[^/]", i + 1
        elif c == "[" and (found := _class(s, i)):
            out, i = out + lead + found[0], found[1]
        else:
            i += c == "\\" and i + 1 < len(s)
            out, i = out + re.escape(s[i]), i + 1
    return out


class Glob:
    """A glob without braces, as the parts of its path."""

    def __init__(self, glob: str, dots: bool):
        parts = [p for p in _split(glob, "/") if p not in ("", ".")]
        self.parts = [None if p == "**" else re.compile(_segment(p, dots)) for p in parts]
        self.dots = dots

    def matches(self, path: list[str]) -> bool:
        return self._walk(path, False)

    def leads(self, folder: list[str]) -> bool:
        """Whether a path below folder can match."""
        return self._walk(folder, True)

    def covers(self, folder: list[str]) -> bool:
        """Whether all paths below folder match."""
        last = bool(self.parts) and self.parts[-1] is None
        return last and self.dots and any(self._walk(folder[:n], False, self.parts[:-1]) for n in range(1, len(folder) + 1))

    def _walk(self, path: list[str], below: bool, parts=None) -> bool:
        parts = self.parts if parts is None else parts

        @functools.cache
        def at(p: int, k: int) -> bool:
            if k == len(path):
                return p < len(parts) if below else all(x is None for x in parts[p:])
            if p == len(parts):
                return False
            if parts[p] is None:
                return at(p + 1, k) or ((self.dots or not path[k].startswith(".")) and at(p, k + 1))
            return bool(parts[p].fullmatch(path[k])) and at(p + 1, k + 1)

        return at(0, 0)


class Wanted:
    """What include and exclude globs want together."""

    def __init__(self, include, exclude):
        turned = [g[1:] for g in include if g.startswith("!") and not g.startswith("!(")]
        self.include = [Glob(x, False) for g in include if g[1:] not in turned or not g.startswith("!") for x in expanded(g)]
        self.exclude = [Glob(x, True) for g in (*exclude, *turned) for x in expanded(g)]

    def file(self, path: str) -> bool:
        parts = path.split("/")
        return any(g.matches(parts) for g in self.include) and not any(g.matches(parts) for g in self.exclude)

    def folder(self, path: str) -> bool:
        """Whether the folder has to be listed."""
        parts = path.split("/")
        return any(g.leads(parts) for g in self.include) and not any(g.covers(parts) for g in self.exclude)


def local_entries(root: str) -> Callable[[str], list[tuple[str, bool]]]:
    """entries(folder): (name, whether it is a folder) of what lies in a folder of this machine; links are left out."""

    def entries(folder: str) -> list[tuple[str, bool]]:
        with os.scandir(os.path.join(root, folder)) as found:
            return [(e.name, e.is_dir(follow_symlinks=False)) for e in found if not e.is_symlink()]

    return entries


def store_entries(spark, root: str) -> Callable[[str], list[tuple[str, bool]]]:
    """The same in any store that Spark reads."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())

    def entries(folder: str) -> list[tuple[str, bool]]:
        place = spark._jvm.org.apache.hadoop.fs.Path(top, folder) if folder else top
        return [(f.getPath().getName(), f.isDirectory()) for f in store.listStatus(place) if not f.isSymlink()]

    return entries


def listed(entries: Callable[[str], list[tuple[str, bool]]], wanted: Wanted) -> Iterator[str]:
    """The wanted paths, folder by folder."""
    folders = [""]
    while folders:
        folder = folders.pop()
        for name, inner in sorted(entries(folder)):
            path = f"{folder}/{name}" if folder else name
            if inner and wanted.folder(path):
                folders.append(path)
            elif not inner and wanted.file(path):
                yield path
