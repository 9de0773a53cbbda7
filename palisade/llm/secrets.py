r"""Secret scans through a trigram inverted index, in column functions only.

Each rule is a regular expression. Its Boolean trigram query (a disjunction of sets of mandatory
trigrams) is derived from the expression's syntax. Postings (trigram, document) are kept for the
trigrams that some query names; postings of a document meet as bits in one aggregation, so that
the intersection is a mask test, and only candidates are verified with the expression. Rules
without mandatory trigrams are run over every text. Postings are a few small rows a document. Candidates are few:
up to a checked size they are broadcast and texts stay where they are; beyond it they are joined by document and text hash.

Null texts are empty; empty texts have no spans. Very long texts are searched whole. A document is its doc_id and its text's 64-bit hash: repeated rows
share candidates, rows of one doc_id or of none with different texts do not. Spans that begin together are in the order of
the rules. An empty table gives no rows. Extra columns are kept; names of ours begin with two underscores.
Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import let, whole_text, written

#: Candidates up to this size are broadcast; bytes that one takes.
BROADCAST_BYTES, ENTRY_BYTES = 32 << 20, 64
BASE_KINDS = ("assign", "access", "hex")


class SecretRule(NamedTuple):
    kind: str
    regex: str
    #: A match counts if this group has so many characters at least.
    group: int = 0
    least: int = 1


#: In the order of output; the first three are the base kinds.
RULES = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]+", 0, 24),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    SecretRule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    SecretRule("live", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
#: Exact strings a part of an expression may stand for, before its trigrams are taken.
MOST_EXACT = 16


def trigram_query(regex: str) -> frozenset[frozenset[str]] | None:
    """Sets of lower-case trigrams, one of which every match holds in full; None if none can be told."""

    def grams(text: str) -> frozenset[str]:
        return frozenset(text[i : i + 3] for i in range(len(text) - 2))

    def least(sets):
        return frozenset(a for a in sets if not any(b < a for b in sets))

    def both(a, b):
        return least({x | y for x in a for y in b})

    anything = frozenset([frozenset()])

    def settle(exact):
        return least({grams(x) for x in exact})

    def sequence(items) -> tuple[set[str] | None, frozenset]:
        """The exact strings of items, or None; the query of what is not exact."""
        exact, query, whole = {""}, anything, True
        for op, arg in items:
            own, need = one(op, arg)
            if own is not None and len(exact) * len(own) <= MOST_EXACT:
                exact = {x + y for x in exact for y in own}
                continue
            query, whole = both(both(query, settle(exact)), need if own is None else settle(own)), False
            exact = {""}
        return (exact, query) if whole else (None, both(query, settle(exact)))

    def one(op, arg):
        if op is sre.LITERAL:
            return {chr(arg).lower()}, anything
        if op is sre.IN:
            chars = {chr(a).lower() for kind, a in arg if kind is sre.LITERAL}
            return (chars, anything) if len(arg) == len([1 for kind, _ in arg if kind is sre.LITERAL]) else (None, anything)
        if op is sre.SUBPATTERN:
            return sequence(arg[3])
        if op is sre.BRANCH:
            parts = [sequence(x) for x in arg[1]]
            if all(e is not None for e, _ in parts):
                return set().union(*(e for e, _ in parts)), anything
            return None, least(frozenset().union(*(settle(e) if e is not None else q for e, q in parts)))
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = arg
            exact, query = sequence(inner)
            if (low, high) == (0, 1) and exact is not None:
                return exact | {""}, anything
            return (None, anything) if low == 0 else (None, query if exact is None else settle(exact))
        return None, anything

    exact, query = sequence(sre_parser.parse(regex))
    query = query if exact is None else settle(exact)
    return None if frozenset() in query else query


class Plan(NamedTuple):
    trigrams: list[str]
    #: For each rule its conjunctions as bit masks over trigrams (one mask for 63 trigrams), or None: scan.
    clauses: list[list[list[int]] | None]


def index_plan(rules=RULES) -> Plan:
    found = [trigram_query(r.regex) for r in rules]
    trigrams = sorted({t for q in found if q for c in q for t in c})
    at = {t: i for i, t in enumerate(trigrams)}
    n = (len(trigrams) + 62) // 63

    def masks(clause):
        out = [0] * n
        for t in clause:
            out[at[t] // 63] |= 1 << at[t] % 63
        return out

    return Plan(trigrams, [None if q is None else sorted(map(masks, q)) for q in found])


def postings(docs: DataFrame, plan: Plan) -> DataFrame:
    """The inverted index: a row (doc_id, mark, trigram number) for each indexed trigram that a document holds; mark is the text's hash."""
    which = lambda text: F.filter(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(i)) for i, t in enumerate(plan.trigrams)]), lambda x: x.isNotNull())
    held = let(F.lower(whole_text(docs)), which)
    return docs.select("doc_id", F.xxhash64(whole_text(docs)).alias("mark"), F.explode(held).alias("trigram"))


def candidates(index: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, mark, rules): the documents whose postings meet a rule's query, rules as bits."""
    words = range((len(plan.trigrams) + 62) // 63)
    bit = F.expr("shiftleft(1L, cast(trigram % 63 as int))")
    met = index.groupBy("doc_id", "mark").agg(*[F.bit_or(F.when(F.floor(F.col("trigram") / 63) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in words])
    rules = F.lit(0).cast("long")
    for r, clauses in enumerate(plan.clauses):
        if clauses:
            hit = F.lit(False)
            for c in clauses:
                all_in = F.lit(True)
                for w, mask in zip(words, c, strict=True):
                    all_in = all_in & (F.col(f"m{w}").bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long"))
                hit = hit | all_in
            rules = rules.bitwiseOR(F.when(hit, F.lit(1 << r).cast("long")).otherwise(F.lit(0).cast("long")))
    return met.select("doc_id", "mark", rules.alias("rules")).where("rules != 0")


def match_spans(text: Column, rule: SecretRule) -> Column:
    """Leftmost non-overlapping matches of rule whose group is long enough, as array<struct<s,e>>."""
    hits, gaps = F.regexp_extract_all(text, F.lit(f"({rule.regex})"), F.lit(0)), F.split(text, rule.regex, -1)
    marked = hits if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(acc, x):
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        good = F.length(x["marked"]) >= rule.least
        return F.struct(e.alias("at"), F.when(good, F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"))))).otherwise(acc["out"]).alias("out"))

    rows = F.filter(F.arrays_zip(hits.alias("hit"), gaps.alias("gap"), marked.alias("marked")), lambda x: x["hit"].isNotNull())
    named = F.transform(rows, lambda x: F.struct(x["hit"].alias("hit"), x["gap"].alias("gap"), x["marked"].alias("marked")))
    return F.aggregate(named, start, step, lambda acc: acc["out"])


def find_secrets(docs: DataFrame, rules=RULES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs and __spans: array<struct<s,k,e>> by start, then rule; k is the rule's number."""
    plan = index_plan(rules)
    cand = written(candidates(postings(docs, plan), plan).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("rules").alias("__rules")), "candidates")
    cand = F.broadcast(cand) if cand.count() * ENTRY_BYTES <= broadcast_bytes else cand.hint("shuffle_hash")
    text = whole_text(docs)
    df = docs.join(cand, docs["doc_id"].eqNullSafe(cand["__id"]) & (F.xxhash64(text) == cand["__mark"]), "left").drop("__id", "__mark")
    none = F.array().cast("array<struct<s:int,e:int>>")
    parts = []
    for k, rule in enumerate(rules):
        found = match_spans(text, rule)
        if plan.clauses[k] is not None:
            found = F.when(F.col("__rules").bitwiseAND(F.lit(1 << k).cast("long")) != 0, found).otherwise(none)
        elif rule.group == 0 and rule.least > 1 and rule.regex.endswith("+"):
            # a cheap test whether a long enough match can be there at all
            found = F.when(text.rlike(rule.regex[:-1] + "{%d}" % rule.least), found).otherwise(none)
        number = F.lit(k)
        parts.append(F.transform(found, lambda x: F.struct(x["s"].alias("s"), number.alias("k"), x["e"].alias("e"))))
    return df.withColumn("__spans", F.sort_array(F.concat(*parts))).drop("__rules")


def spans_text(spans: Column, rules=RULES) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each run of overlapping spans replaced by mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        apart = x["s"] >= acc["at"]
        more = F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(apart, F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(
        let(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.length(text) - d["at"])))
    )


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds and digests of the spans, a row for each document."""
    df = find_secrets(docs)
    count = lambda k: F.size(F.filter("__spans", lambda x: x["k"] == k)).cast("long")
    return df.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)],
        F.sha2(spans_text(F.filter("__spans", lambda x: x["k"] < len(BASE_KINDS))).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("__spans")).alias("spans"),
    )


__all__ = ["RULES", "SecretRule", "find_secrets", "index_plan", "redacted", "secret_digests", "trigram_query"]
