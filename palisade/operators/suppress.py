"""Inline suppressions: directives in comments, their ranges, and the findings they silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.let import let

# The directives' syntax.
DIRECTIVE = r"(?i)hound-(disable-next-line|disable-line|disable|enable)(?![0-9A-Za-z_])([^\n]*)"
RULE_ID = r"([A-Za-z][A-Za-z0-9]*-\d+)"
SILENCED = "array<struct<rule_id:string,line_start:int,line_end:int,evidence:string,suppressed_by:int>>"
MARKS = "array<struct<ord:int,kind:string,line:int,first:int,last:int,rule_ids:array<string>,reason:string>>"


def marks_of(content: Column) -> Column:
    """array of (ord, kind, line, first, last, rule_ids, reason): rule_ids null means every rule; ord is the declaration order.

    A block runs to the first later `enable` that names none, or one of its rules, else to the last line."""
    none = F.lit(None).cast("array<string>")

    def parsed(x):
        tail = F.regexp_extract(x["l"], DIRECTIVE, 2)
        at = F.instr(tail, "--")
        ids = F.transform(F.regexp_extract_all(F.when(at > 0, F.substring(tail, F.lit(1), at - 1)).otherwise(tail), F.lit(RULE_ID), F.lit(1)), F.upper)
        reason = F.trim(F.when(at > 0, F.substring(tail, at + 2, F.length(tail))))
        return F.struct(
            (x["i"] + 1).alias("line"), F.lower(F.regexp_extract(x["l"], DIRECTIVE, 1)).alias("kind"),
            F.when(F.size(ids) > 0, ids).otherwise(none).alias("rule_ids"), F.when(reason != "", reason).alias("reason"),
        )

    def ranged(found, n_lines):
        ends = F.filter(found, lambda d: d["kind"] == "enable")

        def of(d, i):
            closes = F.filter(ends, lambda e: (e["line"] > d["line"]) & (e["rule_ids"].isNull() | d["rule_ids"].isNull() | F.arrays_overlap(e["rule_ids"], d["rule_ids"])))
            first = d["line"] + F.when(d["kind"] == "disable-next-line", 1).otherwise(0)
            last = F.when(d["kind"] == "disable", F.coalesce(F.array_min(F.transform(closes, lambda e: e["line"])), n_lines)).otherwise(first)
            return F.struct((i + 1).cast("int").alias("ord"), d["kind"].alias("kind"), d["line"].alias("line"), first.alias("first"), last.alias("last"), d["rule_ids"].alias("rule_ids"), d["reason"].alias("reason"))

        return F.transform(F.filter(found, lambda d: d["kind"] != "enable"), of)

    def told(lines):
        hits = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("l"), i.alias("i"))), lambda x: x["l"].rlike(DIRECTIVE))
        return let(F.transform(hits, parsed), lambda found: ranged(found, F.size(lines)))

    return F.when(content.rlike(DIRECTIVE), let(F.split(content, "\n", -1), told).cast(MARKS)).otherwise(F.array().cast(MARKS))


def directives(files: DataFrame) -> DataFrame:
    """The marks of files (path, content), a row each."""
    return files.select("path", F.inline(marks_of(F.col("content"))))


def suppressor(marks: Column, line=None, rule=None) -> Column:
    """The ord of the first mark that covers a finding's line and rule, or null."""
    line, rule = F.col("line_start") if line is None else line, F.col("rule_id") if rule is None else rule
    covers = F.filter(marks, lambda d: line.between(d["first"], d["last"]) & _names(d, rule))
    return F.get(covers, F.lit(0))["ord"]


def _names(mark: Column, rule: Column) -> Column:
    return mark["rule_ids"].isNull() | F.array_contains(mark["rule_ids"], rule)


def silenced(found: Column, marks: Column) -> Column:
    """found, an array of matches of one file, each with suppressed_by: the ord of the first of the file's marks that covers it, or null.

    A line has at most one mark of its own and one from the line before, so these are looked up by line; only blocks are tried one by one."""

    def of_kind(kind):
        return F.map_from_entries(F.transform(F.filter(marks, lambda d: d["kind"] == kind), lambda d: F.struct(d["first"], d)))

    def told(index):
        def first(x):
            own = [F.when(_names(d, x["rule_id"]), d["ord"]) for d in (F.try_element_at(index["own"], x["line_start"]), F.try_element_at(index["next"], x["line_start"]))]
            return F.least(*own, suppressor(index["blocks"], x["line_start"], x["rule_id"]))

        return F.transform(found, lambda x: F.struct(x["rule_id"], x["line_start"], x["line_end"], x["evidence"], first(x).alias("suppressed_by")))

    index = F.struct(of_kind("disable-line").alias("own"), of_kind("disable-next-line").alias("next"), F.filter(marks, lambda d: d["kind"] == "disable").alias("blocks"))
    return F.when(F.size(found) > 0, let(index, told)).otherwise(F.array().cast(SILENCED)).cast(SILENCED)


def with_suppressor(findings: DataFrame, found: DataFrame) -> DataFrame:
    """findings and suppressed_by: the ord of the first directive that covers the line and the rule, or null.

    The join is by path, so it needs no broadcast; a file's directives come as one array."""
    per = found.groupBy(F.col("path").alias("__path")).agg(F.sort_array(F.collect_list(F.struct("ord", "first", "last", "rule_ids"))).alias("__d"))
    joined = findings.join(per, F.col("path") == F.col("__path"), "left")
    return joined.withColumn("suppressed_by", suppressor(F.col("__d"))).drop("__path", "__d")


def unused(found: DataFrame, judged: DataFrame) -> DataFrame:
    """Directives that silenced nothing."""
    used = judged.where("suppressed_by is not null").select("path", F.col("suppressed_by").alias("ord")).distinct()
    return found.join(used, ["path", "ord"], "left_anti")
