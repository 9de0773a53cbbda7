"""INJ-015 as columns: names that hold request data, followed through assignments into prompt templates.

A line gives at most one assignment: the names it sets and what stands right of the sign. Cleaned values are
dropped. A name is tainted if its value names a source or a tainted name; as assignments may stand in any order,
the sweep over them is repeated ROUNDS times. Only code prompts that name a source at all get so far.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.let import let
from palisade.functions.regexes import BOUNDARY, P, has, to_java
from palisade.rules.model import MATCH, Prompt, finding, js_trim

# Results depend on these patterns.
SOURCE = P(r"\b(?:req|request)\s*\.\s*(?:body|query|params|headers|cookies|form|args|values)\b|\bprocess\.argv\b|\b(?:window\s*\.\s*)?location\s*\.\s*(?:search|hash|href)\b|\bdocument\s*\.\s*cookie\b|\.searchParams\s*\.\s*get\s*\(", case=True)
CLEANED = r"\b(?:sanitiz|escape|validate|allowlist|allow_list|encodeURI|encodeURIComponent|parseInt|parseFloat|Number\s*\(|\.safeParse\s*\(|z\s*\.\s*\w+|zod|DOMPurify|striptags|escapeHtml)"
USUAL = r"^(?:user[a-z_]*|input|query|message|request|text|prompt|content)$"
PROMPT_LIKE = r"\b(?:you are|your (?:role|task|job)|system|assistant|prompt|answer|summari[sz]|translat|respond|reply|instruction|context)\b"
UNPACK = P(r"(?:const|let|var)\s*\{([^}]+)\}\s*=\s*(.+)$", case=True)
DECLARE = P(r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(.+)$", case=True)
ASSIGN = P(r"^\s*([A-Za-z_$][\w$]*)\s*=\s*(.+)$", case=True)
TEMPLATE = r"`(?:[^`\\]++|\\[\s\S])*+`"
TAKEN_IN = r"\$\{([^}]+)\}"
ROUNDS = 4

_STEP = "struct<names:array<string>,value:string>"


def _unpacked(inside: Column) -> Column:
    """Names that a pattern in braces binds: what stands behind a colon, without a default."""

    def name(part):
        parts = F.split(part, ":", -1)
        bound = F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(part)
        return F.regexp_replace(F.regexp_replace(bound, to_java(P(r"=.*$", case=True)), ""), to_java(P(r"[.\s]", case=True)), "")

    return F.filter(F.transform(F.split(inside, ",", -1), name), lambda n: n != "")


def _assignments(lines: Column) -> Column:
    def step(line):
        part = lambda p, k: F.regexp_extract(line, to_java(p), k)
        form = lambda p, names: F.struct(names.alias("names"), part(p, 2).alias("value")).cast(_STEP)
        return (
            F.when(~line.contains("="), F.lit(None).cast(_STEP))
            .when(has(line, UNPACK), form(UNPACK, _unpacked(part(UNPACK, 1))))
            .when(has(line, DECLARE), form(DECLARE, F.array(part(DECLARE, 1))))
            .when(has(line, ASSIGN), form(ASSIGN, F.array(part(ASSIGN, 1))))
        )

    return F.filter(F.transform(lines, step), lambda s: s.isNotNull() & ~has(s["value"], CLEANED))


def _tainted(steps: Column) -> Column:
    """The names of all tainted assignments."""
    named = lambda value, names: F.exists(names, lambda n: F.regexp_like(value, F.concat(F.lit(BOUNDARY + r"\Q"), n, F.lit(r"\E" + BOUNDARY))))
    sweep = lambda known: F.aggregate(steps, known, lambda acc, s: F.when(has(s["value"], SOURCE) | named(s["value"], acc), F.array_union(acc, s["names"])).otherwise(acc))
    known = F.array().cast("array<string>")
    for _ in range(ROUNDS):
        known = let(known, sweep)
    return known


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _places(text: Column, regex: str, before: Column) -> Column:
    """(line, hit) of each match of regex, lines counted from `before`."""
    hits, gaps = F.regexp_extract_all(text, F.lit(f"({regex})"), F.lit(1)), F.split(text, regex, -1)
    shape = "struct<line:int,out:array<struct<line:int,hit:string>>>"
    zero = F.struct(before.alias("line"), F.array().cast("array<struct<line:int,hit:string>>").alias("out")).cast(shape)
    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))

    def step(acc, p):
        line = acc["line"] + _newlines(p["gap"])
        found = F.struct(line.alias("line"), p["hit"].alias("hit"))
        return F.struct((line + _newlines(p["hit"])).alias("line"), F.concat(acc["out"], F.array(found)).alias("out")).cast(shape)

    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def tainted_prompts(p: Prompt) -> Column:
    """The matches: one for each line whose template takes in a tainted name, told by the first such name."""

    def found(names):
        templates = F.filter(_places(p.text, TEMPLATE, F.lit(0)), lambda t: has(t["hit"], PROMPT_LIKE))
        taken = F.flatten(F.transform(templates, lambda t: _places(t["hit"], r"\$\{[^}]+\}", t["line"])))

        def shown(x):
            inner = js_trim(F.substring(x["hit"], F.lit(3), F.length(x["hit"]) - 3))
            root = F.get(F.split(inner, to_java(P(r"[.\[(?\s]", case=True)), -1), F.lit(0))
            return F.struct(x["line"].alias("line"), root.alias("root"), F.concat(F.lit("${"), inner, F.lit("} (tainted: "), root, F.lit(")")).alias("evidence"))

        hits = F.filter(F.transform(taken, shown), lambda x: (x["root"] != "") & F.array_contains(names, x["root"]) & ~has(x["root"], USUAL))
        one = let(hits, lambda h: F.filter(h, lambda x, i: F.array_position(F.transform(h, lambda y: y["line"]), x["line"]) == i + 1))
        return F.transform(one, lambda x: finding("INJ-015", p.line_start + x["line"], p.line_start + x["line"], x["evidence"])).cast(MATCH)

    none = F.array().cast(MATCH)
    return F.when(has(p.text, SOURCE) & p.text.contains("`"), let(_tainted(_assignments(p.lines)), lambda names: F.when(F.size(names) > 0, found(names)).otherwise(none))).otherwise(none)
