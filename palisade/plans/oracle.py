"""DuckDB SQL for rules that its engine can express, made from the same rule data."""

from __future__ import annotations

from palisade.functions.regexes import P, to_re2
from palisade.functions.sql import quoted
from palisade.operators.findings import MITIGATIONS
from palisade.plans.by_hand import CONDITIONS
from palisade.rules.model import Rule


def _patterns(rule: Rule):
    return (*rule.line, *rule.some, *rule.line_not, *rule.need, *rule.absent, *rule.near, *rule.near_some, *rule.near_not)


def expressible(rule: Rule) -> bool:
    own = rule.test or rule.finds or rule.evidence
    return not own and all(to_re2(p if isinstance(p, P) else P(p)) is not None for p in _patterns(rule))


def _has(what: str, p) -> str:
    return f"regexp_matches({what}, {quoted(to_re2(p if isinstance(p, P) else P(p)))})"


def in_sql(rule: Rule) -> bool:
    """Whether rule_sql knows the rule."""
    return expressible(rule) or rule.id in CONDITIONS


def rule_sql(rule: Rule) -> str:
    """Rows (doc_id, rule_id, line_start) from x (doc_id, t, lines, kind, ext, path, i)."""
    if rule.id in CONDITIONS:
        where, which = CONDITIONS[rule.id]
        line = {"each": "i", "whole": "1", "first": "min(i)"}[which]
        return f"select doc_id, {quoted(rule.id)} as rule_id, {line} as line_start from x where {'i = 1 and ' if which == 'whole' else ''}({where})" + (" group by doc_id" if which == "first" else "")
    parts = ["true"]
    if rule.code:
        parts.append("kind = 'code-block'")
    if rule.not_raw:
        parts.append("kind <> 'raw'")
    if rule.exts:
        parts.append(f"ext in ({', '.join(map(quoted, rule.exts))})")
    if rule.skill:
        parts.append("contains(path, '/skills/')")
    parts += [_has("t", p) for p in rule.need] + [f"not {_has('t', p)}" for p in rule.absent]
    parts += [_has("lines[i]", p) for p in rule.line] + [f"not {_has('lines[i]', p)}" for p in rule.line_not]
    if rule.some:
        parts.append("(" + " or ".join(_has("lines[i]", p) for p in rule.some) + ")")
    window = f"array_to_string(lines[greatest(1, i - {rule.back}):i + {rule.ahead - 1}], chr(10))"
    parts += [_has(window, p) for p in rule.near] + [f"not {_has(window, p)}" for p in rule.near_not]
    if rule.near_some:
        parts.append("(" + " or ".join(_has(window, p) for p in rule.near_some) + ")")
    where = " and ".join(parts)
    if rule.whole:
        return f"select doc_id, {quoted(rule.id)} as rule_id, 1 as line_start from x where i = 1 and {where}"
    if rule.first:
        return f"select doc_id, {quoted(rule.id)} as rule_id, min(i) as line_start from x where {where} group by doc_id"
    return f"select doc_id, {quoted(rule.id)} as rule_id, i as line_start from x where {where}"


def corpus_sql(slots, front: bool = False) -> str:
    """CTEs d (seeded documents) and x (one row a line); slots: (rule, ext, kind, payload)."""
    pick = lambda k: f"list_extract([{', '.join(quoted(s[k]) for s in slots)}], cast(doc_id % {len(slots)} as int) + 1)"
    folder = f"list_extract([{', '.join(quoted('/skills/' if s[0].startswith('SKL') else '/') for s in slots)}], cast(doc_id % {len(slots)} as int) + 1)"
    text = f"{pick(3)} || chr(10) || text" if front else f"text || chr(10) || {pick(3)}"
    return (
        f"d as (select doc_id, source, {text} as t, {pick(2)} as kind, {pick(1)} as ext, source || {folder} || doc_id || {pick(1)} as path from documents), "
        "s as (select *, string_split(t, chr(10)) as lines from d), x as (select *, unnest(range(1, len(lines) + 1)) as i from s)"
    )


def findings_sql(slots, rules, front: bool = False) -> str:
    """WITH text ending in f (doc_id, source, path, rule_id, line_start and the rule's columns, risk_points)."""
    rows = ", ".join(f"({quoted(r.id)}, {quoted(r.prefix)}, {quoted(r.severity)}, {quoted(r.confidence)}, {quoted(r.category)}, {r.base_points})" for r in rules)
    soft = {p: [] for r in rules for p in [r.prefix]}
    for regex, percent, prefixes in MITIGATIONS:
        for p in prefixes:
            if p in soft:
                soft[p].append(f"case when {_has('t', regex)} then {percent} else 0 end")
    cases = " ".join(f"when {quoted(p)} then {' + '.join(v)}" for p, v in soft.items() if v)
    red = f"case prefix {cases} else 0 end" if cases else "0"
    return (
        f"with {corpus_sql(slots, front)}, r(rule_id, prefix, severity, confidence, category, base_points) as (values {rows}), "
        f"m as ({' union all '.join(rule_sql(r) for r in rules)}), "
        f"f as (select doc_id, source, path, rule_id, line_start, severity, confidence, category, greatest(1, (base_points * (100 - ({red})) + 50) // 100) as risk_points from m join r using (rule_id) join d using (doc_id)) "
    )
