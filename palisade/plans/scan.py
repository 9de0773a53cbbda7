"""The scan from files to judged findings, as one lazy plan."""

from __future__ import annotations

import dataclasses
import hashlib
import inspect
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.spread import spread
from palisade.operators.extract import extract_prompts
from palisade.operators.findings import findings
from palisade.operators.scoring import first_files, repo_result
from palisade.operators.suppress import directives, marks_of, unused
from palisade.rules.catalogue import select
from palisade.rules.model import Rule


@dataclass(frozen=True)
class Scan:
    kept: DataFrame
    suppressed: DataFrame
    unused_directives: DataFrame

    def result(self, **gates) -> DataFrame:
        return repo_result(self.kept, **gates)


def scan(files: DataFrame, include=(), exclude=(), min_confidence: str | None = None, max_findings: int = 0, extra: tuple[Rule, ...] = ()) -> Scan:
    """files (path, content) through extraction, rules, duplicates, suppressions and the findings limit."""
    from palisade.rules.catalogue import RULES

    return judge(files, scan_rules(files, select(include, exclude, min_confidence, (*RULES, *extra))), max_findings)


def scan_rules(files: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of files (path, content), with suppressed_by."""
    # marks come along with the prompts, so files are read once; no shuffle has them
    marked = spread(files).select("path", F.coalesce("content", F.lit("")).alias("content")).withColumn("marks", marks_of(F.col("content")))
    return findings(extract_prompts(marked, ("marks",)), rules, marks="marks")


def judge(files: DataFrame, judged: DataFrame, max_findings: int = 0, marks: DataFrame | None = None) -> Scan:
    """The result for findings with suppressed_by; write judged first if more than one part of the result is wanted.

    marks: the files' directives, if they are known already."""
    kept = judged.where("suppressed_by is null").drop("suppressed_by")
    return Scan(first_files(kept, max_findings), judged.where("suppressed_by is not null"), unused(directives(files) if marks is None else marks, judged))


def _told(value) -> str:
    """A rule's field as text; a function by its code, constants and the source of its module."""
    if not callable(value):
        return repr(value)
    code = getattr(value, "__code__", None)
    try:
        module = inspect.getsource(sys.modules[value.__module__])
    except (OSError, TypeError, KeyError):
        module = ""
    return repr((value.__module__, code and code.co_code.hex(), code and [c for c in code.co_consts if isinstance(c, str | int | tuple)], hashlib.sha256(module.encode()).hexdigest()))


def signature(rules: tuple[Rule, ...], include=(), exclude=(), min_confidence: str | None = None) -> str:
    """What a cached result depends on besides the file: every field of every rule, and the selection."""
    parts = sorted(repr([_told(getattr(r, f.name)) for f in dataclasses.fields(r)]) for r in rules)
    return "3-" + hashlib.sha256("\n".join([*parts, *sorted(include), *sorted(exclude), min_confidence or ""]).encode()).hexdigest()[:16]
