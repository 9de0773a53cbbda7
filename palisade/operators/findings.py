"""Rule evaluation over prompts: one narrow projection, then one small shuffle to settle duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions.literals import required
from palisade.functions.matcher import BITS, held
from palisade.functions.regexes import has
from palisade.functions.utf16 import prefix
from palisade.operators.suppress import silenced
from palisade.rules.catalogue import FAMILIES, RULES
from palisade.rules.model import EVIDENCE_UNITS, MATCH, Prompt, Rule, compile_rule, required_groups
from palisade.ship import ship

#: What softens a finding, its reduction in per cent, the rule prefixes it applies to.
MITIGATIONS = (
    (r"(?:system instructions? (cannot|can't|must not) be (changed|modified|overridden|ignored)|these instructions? (are|remain) (permanent|fixed|immutable)|ignore (any|all) attempts? to (change|modify|override) (your|these) instructions?)", 15, ("JBK",)),
    (r"(?:```[\s\S]*?```|<user>[\s\S]*?<\/user>|\[USER\][\s\S]*?\[\/USER\]|untrusted (user )?(?:content|input)|user.{0,20}(not|never) (an instruction|trusted|a command))", 20, ("INJ",)),
    (r"(?:never (reveal|repeat|share|disclose|expose|show|print) (your|the|these) (system |hidden |initial |original )?(?:prompt|instructions?)|do not (reveal|repeat|share|disclose) (this|these|your|the) (system )?(?:prompt|instructions?))", 15, ("EXF",)),
    (r"(?:only (use|call|invoke) (the )?(following|listed|allowed|approved)|allowlist|permitted tools?|restricted to.{0,30}(tools?|functions?))", 10, ("TOOL", "AGT", "MCP")),
    (r"(?:untrusted (external |retrieved )?content|external content.{0,40}(may|might|could) (contain|include) instructions?|do not (follow|execute|treat).{0,30}(retrieved|external|context))", 10, ("RAG",)),
    (r"(?:sanitize|sanitise|escape|htmlEscape|DOMPurify\.sanitize|validator\.escape|xss\s*\(|encodeURIComponent|stripTags|purify\.sanitize)\s*\(", 15, ("INJ",)),
)


def rules_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rules' metadata: as many rows as rules."""
    rows = [(i, r.id, r.prefix, r.title, r.severity, r.confidence, r.category, r.mitre, r.remediation, r.base_points) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_ord int, rule_id string, prefix string, title string, severity string, confidence string, category string, mitre string, remediation string, base_points int")


def mitigation_groups() -> tuple[tuple[tuple[str, ...], ...], ...]:
    """For each of MITIGATIONS the strings of which a text that it matches holds one, as for the rules."""
    return tuple((words,) if (words := required(regex)) else () for regex, _, _ in MITIGATIONS)


def mitigations(text: Column, bits: Column, prefixes: frozenset[str]) -> dict[str, Column]:
    """Reduction in per cent for each of the rule prefixes that has one; bits: which of MITIGATIONS the text can match."""
    out: dict[str, Column] = {}
    for i, (regex, percent, own) in enumerate(MITIGATIONS):
        part = F.when((F.getbit(bits, F.lit(i)) == 1) & has(text, regex), F.lit(percent)).otherwise(F.lit(0))
        for p in own:
            if p in prefixes:
                out[p] = out[p] + part if p in out else part
    return out


def adjusted_points(base: Column, reduction: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((base * (100 - reduction) + 50) / 100)).cast("int")


_compiled: dict[tuple, Column] = {}


def _column(app: str, place: int, rules: tuple[Rule, ...]) -> Column:
    """The rules' matches over columns of fixed names; made once for each application, as it takes many calls into the JVM.

    place: that of the rules' bits in the column `held`."""
    key = (app, place, rules)
    if key not in _compiled:
        bits = F.get(F.col("held"), F.lit(place))
        prompt = Prompt(*(F.col(c) for c in ("text", "low", "lines", "kind", "ext", "path", "line_start", "line_end")), held=bits)
        found = F.concat(*[compile_rule(r, prompt, i) for i, r in enumerate(rules)])
        _compiled[key] = F.when(bits != 0, found).otherwise(F.array().cast(MATCH))
    return _compiled[key]


def raw_matches(prompts: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = (), carry: tuple[str, ...] = (), every: bool = False, marks: str | None = None) -> DataFrame:
    """Every match, duplicates among overlapping prompts included, with the prompt's reductions.

    marks: the column of the file's directives; matches then have suppressed_by, and the directives go no further.

    every: a prompt without a match has a row whose rule_id is null. No row is moved, so it also works on streams."""
    own = ["path", *keep, *carry, "prompt_ord", "kind"]
    along = [marks] if marks else []
    families = [tuple(r for r in family if r in rules) for family in FAMILIES.values()]
    plugged = tuple(r for r in rules if not any(r in f for f in FAMILIES.values()))
    families = [f for f in (*families, *(plugged[i : i + BITS] for i in range(0, len(plugged), BITS))) if f]
    ship(prompts.sparkSession)  # the matcher runs on Python workers
    app = prompts.sparkSession.sparkContext.applicationId
    df = prompts.withColumn("low", F.lower("text"))
    df = df.withColumns({"lines": F.split("text", "\n", -1), "held": held(F.col("low"), (*(tuple(map(required_groups, f)) for f in families), mitigation_groups()))})
    columns = [_column(app, i, family) for i, family in enumerate(families)]
    # an expression for each family; the arrays meet in one explode
    wide = df.select(*own, *along, "text", F.get("held", F.lit(len(families))).alias("__soft"), *[c.alias(f"__f{i}") for i, c in enumerate(columns)])
    found = wide.select(*own, *along, "text", "__soft", (F.concat(*[F.col(f"__f{i}") for i in range(len(columns))]) if columns else F.array().cast(MATCH)).alias("__found"))
    # what softens a finding is looked for only where there is one, and only for prefixes that the rules have
    parts = mitigations(F.col("text"), F.col("__soft"), frozenset(r.prefix for r in rules))
    soft = F.map_from_arrays(F.array(*map(F.lit, parts)), F.array(*parts.values())) if parts else F.lit(None).cast("map<string,int>")
    matches = silenced(F.col("__found"), F.col(marks)).alias("__found") if marks else F.col("__found")
    told = found.select(*own, F.when(F.size("__found") > 0, soft).alias("soft"), matches)
    # the outer form, as for the other one the optimiser infers a filter that runs every rule once more
    rows = told.select(*own, "soft", F.inline_outer("__found"))
    return (rows if every else rows.where("rule_id is not null")).withColumn("evidence", prefix(F.col("evidence"), EVIDENCE_UNITS))


def first_of_duplicates(matches: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A finding for each (path, rule, line): that of the first prompt."""
    w = W.partitionBy("path", *keep, "rule_id", "line_start").orderBy("prompt_ord", "evidence")
    return matches.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def findings(prompts: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = (), carry: tuple[str, ...] = (), marks: str | None = None) -> DataFrame:
    """(path, keep, carry, rule columns, line_start, line_end, evidence, risk_points) of prompts (path, ext, prompt_ord, kind, text, line_start, line_end).

    keep: columns that tell prompts of one path apart; carry: columns that only come along; marks: that of the file's directives, which gives suppressed_by."""
    joined = with_points(first_of_duplicates(raw_matches(prompts, rules, keep, carry, marks=marks), keep), rules)
    return joined.select("path", *keep, *carry, *(["suppressed_by"] if marks else []), "rule_id", "title", "severity", "confidence", "category", "mitre", "remediation", "rule_ord", "prompt_ord", "kind", "line_start", "line_end", "evidence", "risk_points")


def with_points(matches: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """matches with the rules' columns and risk_points; those without a rule stay, with nulls."""
    # the rules' table has a fixed number of rows
    joined = matches.join(F.broadcast(rules_table(matches.sparkSession, rules)), "rule_id", "left")
    points = adjusted_points(F.col("base_points"), F.coalesce(F.get(F.map_values(F.map_filter("soft", lambda k, v: k == F.col("prefix"))), F.lit(0)), F.lit(0)))
    return joined.withColumn("risk_points", points)
