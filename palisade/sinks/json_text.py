"""JSON text as column expressions, indented by two blanks."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.let import let

#: How control characters are written; of the others only the quote and the backslash are.
CONTROLS = {chr(c): json.dumps(chr(c))[1:-1] for c in range(32)}


def quoted(text: Column) -> Column:
    """A JSON string."""

    def escaped(t):
        out = F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        full = out
        for c, written in CONTROLS.items():
            full = F.replace(full, F.lit(c), F.lit(written))
        return F.when(t.rlike(r"[\x00-\x1f]"), full).otherwise(out)

    return F.concat(F.lit('"'), let(text, escaped), F.lit('"'))


class Maybe:
    """A member that is left out where its value is null."""

    def __init__(self, value: Column):
        self.value = value


def indented(x, depth: int) -> Column:
    """x as JSON, its first line at the place where it is put and the others `depth` levels in.

    Columns stand for JSON text, dicts and lists for themselves, all else for constants."""
    if isinstance(x, Column):
        return x
    if not isinstance(x, dict | list):
        return F.lit(json.dumps(x, ensure_ascii=False))
    pad, pairs = "  " * (depth + 1), x.items() if isinstance(x, dict) else ((None, v) for v in x)
    members = []
    for key, v in pairs:
        name = pad + (f"{json.dumps(key)}: " if key is not None else "")
        # concat_ws leaves nulls out
        value = F.concat(F.lit(name), v.value if isinstance(v, Maybe) else indented(v, depth + 1))
        members.append(value)
    open_, close = "{}" if isinstance(x, dict) else "[]"
    return F.concat(F.lit(open_ + "\n"), F.concat_ws(",\n", *members), F.lit("\n" + "  " * depth + close))
