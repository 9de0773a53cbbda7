"""A rule is data: which prompts it looks at, what a line must hold, and what must stand around it.

compile_rule turns it into a Column of type array<finding> over the prompt columns, so rules are plain
expressions that Spark plans. Before any expression is tried on a text, strings are looked for without which it
cannot match (functions/literals.py): for all rules at once (functions/matcher.py), or for one rule by itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.literals import required
from palisade.functions.regexes import SPACE_CHARS, P, has

SEVERITIES = {"low": 5, "medium": 15, "high": 30, "critical": 50}
CONFIDENCES = {"low": 50, "medium": 75, "high": 100}
CONFIDENCE_ORDER = ("low", "medium", "high")
EVIDENCE_UNITS = 200
MATCH = "array<struct<rule_id:string,line_start:int,line_end:int,evidence:string>>"


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    confidence: str
    category: str
    mitre: str | None
    title: str
    #: Every pattern here must be in the line; of `some` at least one (if any are given), of `line_not` none.
    line: tuple = ()
    some: tuple = ()
    line_not: tuple = ()
    #: The same for the whole prompt text.
    need: tuple = ()
    absent: tuple = ()
    code: bool = False
    not_raw: bool = False
    skill: bool = False
    exts: tuple = ()
    #: Lines before, and lines from the line itself on, that make its window; near must all be in it, near_some one, near_not none.
    back: int = 0
    ahead: int = 1
    near: tuple = ()
    near_some: tuple = ()
    near_not: tuple = ()
    first: bool = False
    whole: bool = False
    #: Own parts: test(prompt, line, i) for a line, or finds(prompt) for the whole array of matches.
    test: Callable | None = None
    finds: Callable | None = None
    evidence: Callable | None = None
    remediation: str = field(default="Keep untrusted content apart from instructions, and check what the finding shows.")

    @property
    def base_points(self) -> int:
        return (SEVERITIES[self.severity] * CONFIDENCES[self.confidence] + 50) // 100

    @property
    def prefix(self) -> str:
        return self.id.split("-")[0]


@dataclass(frozen=True)
class Prompt:
    """The columns a rule sees; low is the text in lower case."""

    text: Column
    low: Column
    lines: Column
    kind: Column
    ext: Column
    path: Column
    line_start: Column
    line_end: Column
    #: Bits of the rules whose required strings the text holds, in the order in which the rules are compiled.
    held: Column | None = None

    def window(self, i: Column, back: int, ahead: int) -> Column:
        begin = F.greatest(i - back, F.lit(0))
        return F.array_join(F.slice(self.lines, begin + 1, i + ahead - begin), "\n")


def js_trim(col: Column) -> Column:
    # from both ends: an expression would look at every character between them
    return F.btrim(col, F.lit(SPACE_CHARS))


def finding(rule_id: str, start: Column, end: Column, evidence: Column) -> Column:
    return F.struct(F.lit(rule_id).alias("rule_id"), start.cast("int").alias("line_start"), end.cast("int").alias("line_end"), evidence.alias("evidence"))


def is_skill(path: Column) -> Column:
    norm = F.lower(F.translate(path, "\\", "/"))
    return (F.element_at(F.split(norm, "/"), -1) == "skill.md") | norm.contains("/skills/") | norm.contains(".openclaw") | norm.contains("clawhub")


def _all(parts) -> Column | None:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def _any(parts) -> Column | None:
    out = None
    for p in parts:
        out = p if out is None else out | p
    return out


def required_groups(rule: Rule) -> tuple[tuple[str, ...], ...]:
    """Groups of strings: a text that the rule matches holds, in lower case, one string of each."""
    told = lambda p: required(p.regex if isinstance(p, P) else p)
    groups = [told(p) for p in (*rule.need, *(() if rule.finds else (*rule.line, *rule.near)))]
    for some in (rule.some, rule.near_some):
        words = [told(p) for p in some]
        groups.append(tuple(dict.fromkeys(w for own in words for w in own)) if not rule.finds and all(words) else ())
    return tuple(dict.fromkeys(g for g in groups if g))


def gate(rule: Rule, prompt: Prompt, bit: int = 0) -> Column | None:
    """What the prompt must meet before any line is looked at; the cheapest tests come first."""
    parts = []
    if rule.code:
        parts.append(prompt.kind == "code-block")
    if rule.not_raw:
        parts.append(prompt.kind != "raw")
    if rule.exts:
        parts.append(prompt.ext.isin(*rule.exts))
    if rule.skill:
        parts.append(is_skill(prompt.path))
    if groups := required_groups(rule):
        parts += [F.getbit(prompt.held, F.lit(bit)) == 1] if prompt.held is not None else [_any(prompt.low.contains(w) for w in g) for g in groups]
    parts += [has(prompt.text, p) for p in rule.need]
    parts += [~has(prompt.text, p) for p in rule.absent]
    if not rule.whole:
        # a line that matches is part of the text: skip texts that cannot have one
        free = lambda p: not any(a in (p.regex if isinstance(p, P) else p) for a in "^$")
        parts += [has(prompt.text, p) for p in rule.line if free(p)]
        if rule.some and all(map(free, rule.some)):
            parts.append(_any(has(prompt.text, p) for p in rule.some))
    return _all(parts)


def line_test(rule: Rule, prompt: Prompt, line: Column, i: Column) -> Column:
    parts = [has(line, p) for p in rule.line]
    if rule.some:
        parts.append(_any(has(line, p) for p in rule.some))
    parts += [~has(line, p) for p in rule.line_not]
    if rule.near or rule.near_some or rule.near_not:
        window = prompt.window(i, rule.back, rule.ahead)
        parts += [has(window, p) for p in rule.near]
        if rule.near_some:
            parts.append(_any(has(window, p) for p in rule.near_some))
        parts += [~has(window, p) for p in rule.near_not]
    if rule.test is not None:
        parts.append(rule.test(prompt, line, i))
    return _all(parts)


def compile_rule(rule: Rule, prompt: Prompt, bit: int = 0) -> Column:
    """array<finding> of the rule in the prompt, in line order, with evidence uncut; bit: the rule's own in prompt.held."""
    none = F.array().cast(MATCH)
    if rule.finds is not None:
        found = rule.finds(prompt)
    elif rule.whole:
        text = rule.evidence(prompt, None) if rule.evidence else js_trim(F.get(prompt.lines, F.lit(0)))
        found = F.array(finding(rule.id, prompt.line_start, prompt.line_start, text))
    else:
        rows = F.transform(prompt.lines, lambda x, i: F.struct(x.alias("l"), i.alias("i")))
        hits = F.filter(rows, lambda x: line_test(rule, prompt, x["l"], x["i"]))
        if rule.first:
            hits = F.slice(hits, 1, 1)
        shown = rule.evidence or (lambda _, x: js_trim(x))
        found = F.transform(hits, lambda x: finding(rule.id, prompt.line_start + x["i"], prompt.line_start + x["i"], shown(prompt, x["l"])))
    met = gate(rule, prompt, bit)
    return found.cast(MATCH) if met is None else F.when(met, found.cast(MATCH)).otherwise(none)
