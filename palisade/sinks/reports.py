"""Reports on findings. What goes to a file is a Document: its text is made of column expressions, sorted and
written by Spark, and only counts and the rules' metadata come to the driver. The console and workflow commands are printed, row by row.

Findings are unique by path, rule and line, as scans give them. With a column file_score, that is a file's score; else
the sum of its findings' points is."""

from __future__ import annotations

import html
import itertools
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.sinks.documents import Document, collated
from palisade.sinks.json_text import Maybe, indented, quoted

# Names and levels of the formats.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
ANNOTATIONS = {"critical": "error", "high": "error", "medium": "warning", "low": "notice"}
#: Column of the csv report and the finding's field.
CSV_COLUMNS = {
    "rule_id": "id", "severity": "severity", "confidence": "confidence", "file": "file", "line_start": "lineStart", "line_end": "lineEnd", "title": "title",
    "evidence": "evidence", "remediation": "remediation", "mitre_technique": "mitre",
}
CSV_HEADER = ",".join(CSV_COLUMNS)
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
MITRE_URL = "https://attack.mitre.org/techniques/"
SEVERITY_ORDER = ("critical", "high", "medium", "low")
_PLACE = ("path", "line_start", "rule_id")


def in_order() -> tuple:
    """The order of findings."""
    return *collated(), "line_start", "rule_id"


def _sections() -> tuple:
    """The order of rows in a report: its sections, files, a file's parts, and lines."""
    return "section", *collated(), "part", "line_start", "rule_id"


def finding_struct() -> Column:
    c = F.col
    return F.struct(
        c("rule_id").alias("id"), "title", "severity", "confidence", "evidence", c("path").alias("file"), c("line_start").alias("lineStart"),
        c("line_end").alias("lineEnd"), "remediation", c("risk_points").alias("riskPoints"), "mitre",
    )


def _text(*parts) -> Column:
    """Strings as they stand, and columns."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _of(values: dict[str, str], key: str = "severity") -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(key))


def _row(section: int, part: int, value: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), F.lit(part).alias("part"), value.alias("value"))


def _rows(findings: DataFrame, *rows: Column) -> DataFrame:
    """Some rows of a report for each finding."""
    return findings.select("path", "line_start", "rule_id", F.explode(F.array(*rows)).alias("r")).select("path", "line_start", "rule_id", "r.*")


def _by_file(findings: DataFrame) -> DataFrame:
    """A row for each file: path, score, n, and the place of its last finding."""
    score = F.max("file_score") if "file_score" in findings.columns else F.sum("risk_points")
    return findings.groupBy("path").agg(score.alias("score"), F.count("*").alias("n"), F.max(F.struct("line_start", "rule_id")).alias("last"))


def _file_rows(files: DataFrame, *rows: Column) -> DataFrame:
    return files.select("path", F.lit(0).alias("line_start"), F.lit("").alias("rule_id"), F.explode(F.array(*rows)).alias("r")).select("path", "line_start", "rule_id", "r.*")


def counts(findings: DataFrame) -> list[tuple[str, int]]:
    """The number of findings of each severity, 0 included."""
    n = dict(map(tuple, findings.groupBy("severity").count().collect()))
    return [(s, n.get(s, 0)) for s in SEVERITY_ORDER]


def rules_found(findings: DataFrame) -> list[dict]:
    """The rules that found something, as many rows as rules."""
    names = ("title", "remediation", "mitre")
    rows = findings.groupBy(F.col("rule_id").alias("id")).agg(*[F.first(x).alias(x) for x in names]).orderBy("id").collect()
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in rows]


# json lines, csv and workflow commands


def json_lines(findings: DataFrame) -> DataFrame:
    """One finding a row as JSON; a missing tag is left out."""
    return findings.select(*_PLACE, F.to_json(finding_struct()).alias("value"))


def jsonl(findings: DataFrame) -> Document:
    return Document(json_lines(findings), in_order())


def csv_rows(findings: DataFrame) -> DataFrame:
    """One finding a row, without the header; a missing tag is empty."""
    f = findings.select(*_PLACE, finding_struct().alias("f"))

    def cell(name):
        text = F.coalesce(F.col(f"f.{name}").cast("string"), F.lit(""))
        return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return f.select(*_PLACE, F.concat_ws(",", *[cell(c) for c in CSV_COLUMNS.values()]).alias("value"))


def csv(findings: DataFrame) -> Document:
    header = findings.sparkSession.createDataFrame([("", 0, "", CSV_HEADER)], "path string, line_start int, rule_id string, value string")
    rows = csv_rows(findings).withColumn("section", F.lit(1)).unionByName(header.withColumn("section", F.lit(0)))
    return Document(rows, ("section", *in_order()))


def annotation_rows(findings: DataFrame) -> DataFrame:
    """Workflow commands, one a finding."""
    line = _text("::", _of(ANNOTATIONS), " file=", F.translate("path", "\\", "/"), ",line=", F.col("line_start"), ",endLine=", F.col("line_end"), ",title=", F.col("rule_id"), "::", F.col("title"), " [", F.upper("severity"), "]")
    return findings.select(*_PLACE, line.alias("value"))


def summary(result: dict, counted: list[tuple[str, int]]) -> str:
    """A short table for a workflow's summary page."""
    state = "passed" if result["passed"] else "failed"
    out = ["## Palisade scan", "", f"**Score:** {result['repoScore']}/100 ({result['scoreLabel'].upper()}), {state}", "", "| Severity | Count |", "|----------|-------|"]
    return "\n".join([*out, *(f"| {s} | {n} |" for s, n in counted)]) + "\n"


# json


def _finding(depth: int) -> Column:
    c = lambda name: quoted(F.col(name))
    n = lambda name: F.col(name).cast("string")
    return indented({
        "id": c("rule_id"), "title": c("title"), "severity": c("severity"), "confidence": c("confidence"), "evidence": c("evidence"), "file": c("path"), "lineStart": n("line_start"),
        "lineEnd": n("line_end"), "remediation": c("remediation"), "riskPoints": n("risk_points"), "mitre": Maybe(c("mitre")),
    }, depth)


def json_report(result: dict, findings: DataFrame) -> Document:
    """The result, its files with their findings, and all findings once more."""
    files = _by_file(findings)
    end = files.agg(F.max_by("path", F.struct(*(k.alias(f"k{i}") for i, k in enumerate(collated()))))).first()[0]
    # the last finding of a file and the last file have no comma behind them
    found = findings.join(files.select("path", "last"), "path")
    comma = F.when((F.col("line_start") == F.col("last.line_start")) & (F.col("rule_id") == F.col("last.rule_id")), "").otherwise(",")
    rows = _rows(found, _row(0, 1, _text("        ", _finding(4), comma)), _row(2, 0, _text("    ", _finding(2), ",")))
    rows = rows.unionByName(_file_rows(
        files, _row(0, 0, _text('    {\n      "file": ', quoted(F.col("path")), ',\n      "findings": [')),
        _row(0, 2, _text('      ],\n      "fileScore": ', F.col("score"), "\n    }", F.when(F.col("path") == F.lit(end), "").otherwise(","))),
    ))
    if end is not None:
        between = findings.sparkSession.createDataFrame([("", 0, "", 1, 0, '  ],\n  "allFindings": [')], "path string, line_start int, rule_id string, section int, part int, value string")
        rows = rows.unionByName(between)
    told = "".join(f"  {json.dumps(k)}: {json.dumps(v, ensure_ascii=False)},\n" for k, v in result.items())
    empty = end is None
    return Document(rows, _sections(), "{\n" + told + ('  "files": []' if empty else '  "files": [\n'), "\n}" if empty else "\n  ]\n}", 1, ',\n  "allFindings": []')


# sarif


def _sarif_rule(r: dict) -> dict:
    tags = ["security", "prompt-injection", *([f"attack:{r['mitre']}"] if "mitre" in r else [])]
    rule = {"id": r["id"], "shortDescription": {"text": r["title"]}, "help": {"text": r["remediation"]}, "properties": {"tags": tags}}
    if "mitre" in r:
        rule["helpUri"] = MITRE_URL + r["mitre"].replace(".", "/") + "/"
    return rule


def sarif(findings: DataFrame) -> Document:
    driver = {"name": "palisade", "version": "1.0.0", "rules": [_sarif_rule(r) for r in rules_found(findings)]}
    tool = json.dumps({"driver": driver}, indent=2, ensure_ascii=False).replace("\n", "\n      ")
    region = {"startLine": F.col("line_start").cast("string"), "endLine": F.col("line_end").cast("string")}
    place = {"physicalLocation": {"artifactLocation": {"uri": quoted(F.col("path")), "uriBaseId": "%SRCROOT%"}, "region": region}}
    item = {"ruleId": quoted(F.col("rule_id")), "level": quoted(_of(LEVELS)), "message": {"text": quoted(_text(F.col("title"), ": ", F.col("evidence")))}, "locations": [place]}
    rows = findings.select(*_PLACE, _text("        ", indented(item, 4), ",").alias("value"))
    head = f'{{\n  "$schema": {json.dumps(SARIF_SCHEMA)},\n  "version": "2.1.0",\n  "runs": [\n    {{\n      "tool": {tool},\n      "results": [\n'
    return Document(rows, in_order(), head, "\n      ]\n    }\n  ]\n}", 1)


# junit, markdown and html


def _xml(col: Column) -> Column:
    for c, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        col = F.replace(col, F.lit(c), F.lit(written))
    return col


def junit(findings: DataFrame) -> Document:
    total = sum(n for _, n in counts(findings))
    c = F.col
    tag = F.coalesce(_text("\nMITRE ATT&CK: ", c("mitre")), F.lit(""))
    body = _text("File: ", c("path"), "\nLine: ", c("line_start"), "\nEvidence: ", c("evidence"), tag, "\nRemediation: ", c("remediation"))
    case = _text(
        '    <testcase name="', _xml(_text(c("rule_id"), ": ", c("title"))), '" classname="', _xml(c("path")), '" time="0">\n      <failure message="', _xml(_text(c("rule_id"), " [", c("severity"), "]: ", c("title"))),
        '" type="', _xml(c("severity")), '">', _xml(body), "</failure>\n    </testcase>",
    )
    files = _by_file(findings)
    rows = _rows(findings, _row(0, 1, case)).unionByName(_file_rows(
        files, _row(0, 0, _text('  <testsuite name="', _xml(c("path")), '" tests="', c("n"), '" failures="', c("n"), '" errors="0" time="0">')), _row(0, 2, F.lit("  </testsuite>")),
    ))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuites name="palisade" tests="{total}" failures="{total}" errors="0" time="0">\n'
    return Document(rows, _sections(), head, ("\n" if total else "") + "</testsuites>")


BADGE = "![{0}](https://img.shields.io/badge/palisade-{0}-{1})"


def _html(col: Column) -> Column:
    for c, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        col = F.replace(col, F.lit(c), F.lit(written))
    return col


def markdown(result: dict, findings: DataFrame) -> Document:
    c = F.col
    clean = F.translate(F.replace(c("title"), F.lit("|"), F.lit("\\|")), "\n", " ")
    link = _text("[", c("mitre"), f"]({MITRE_URL}", F.translate("mitre", ".", "/"), ")")
    badge = BADGE.format("PASSED", "brightgreen") if result["passed"] else BADGE.format("FAILED", "red")
    counted = counts(findings)
    out = [f"# Palisade report {badge}", "", f"**Score:** {result['repoScore']}/100 ({result['scoreLabel'].upper()})  "]
    out += [f"**Threshold:** {result['threshold']}  "] if "threshold" in result else []
    out += [f"**Total findings:** {sum(n for _, n in counted)}", "", "## Severity Summary", "", "| Severity | Count |", "|----------|-------|", *(f"| {s} | {n} |" for s, n in counted), ""]
    short = _text("| ", c("rule_id"), " | ", c("severity"), " | ", c("line_start"), " | ", clean, " | ", F.coalesce(link, F.lit("")), " |")
    tag = F.coalesce(_text("**MITRE ATT&CK:** ", link, "\n\n"), F.lit(""))
    long = _text("\n<details>\n<summary><strong>", c("rule_id"), "</strong>: ", _html(c("title")), "</summary>\n\n**Evidence:** `", c("evidence"), "`\n\n", tag, "**Remediation:** ", c("remediation"), "\n\n</details>")
    rows = _rows(findings, _row(0, 1, short), _row(0, 2, long)).unionByName(_file_rows(
        _by_file(findings), _row(0, 0, _text("### `", c("path"), "`\n*File score: ", c("score"), "*\n\n| Rule | Severity | Line | Title | MITRE |\n|------|----------|------|-------|-------|")), _row(0, 3, F.lit("")),
    ))
    some = sum(n for _, n in counted) > 0
    return Document(rows, _sections(), "\n".join(out) + "\n" + ("## Findings by File\n\n" if some else ""), "\n" if some else "")


def html_page(result: dict, findings: DataFrame) -> Document:
    """A table, and the same rows as embedded data."""
    cells = _text("<tr>", *(x for name in ("path", "line_start", "rule_id", "severity", "title", "evidence") for x in ("<td>", _html(F.col(name).cast("string")), "</td>")), "</tr>")
    safe = lambda col: F.replace(col, F.lit("</"), F.lit("<\\/"))
    rows = _rows(findings, _row(0, 0, cells), _row(2, 0, _text(safe(F.to_json(finding_struct())), ",")))
    data = json.dumps(result).replace("</", "<\\/")
    between = f"</table><script type='application/json' id='data'>{{\"result\": {data}, \"findings\": ["
    counted = counts(findings)
    some = sum(n for _, n in counted) > 0
    if some:
        rows = rows.unionByName(findings.sparkSession.createDataFrame([("", 0, "", 1, 0, between)], "path string, line_start int, rule_id string, section int, part int, value string"))
    told = ", ".join(f"{s} {n}" for s, n in counted)
    head = f"<!doctype html><meta charset=utf-8><title>Palisade report</title><h1>Score {result['repoScore']} ({html.escape(result['scoreLabel'])})</h1><p>{told}</p><table>\n"
    return Document(rows, _sections(), head, "]}</script>", 1, between)


# console


def console_lines(result: dict, findings: DataFrame, verbose: bool = False) -> Iterator[str]:
    """Lines for a terminal, which come to the driver one after the other."""
    counted = counts(findings)
    if not any(n for _, n in counted):
        yield "No findings.\n"
    scored = findings.join(_by_file(findings).select("path", "score"), "path").select(*_PLACE, finding_struct().alias("f"), "score")
    for f, own in itertools.groupby(scored.orderBy(*in_order()).select("f", "score").toLocalIterator(), key=lambda x: x["f"]["file"]):
        for k, (r, score) in enumerate(own):
            if not k:
                yield f"{f} (file score: {score})\n"
            yield f"  [{r['severity'].upper()}] {r['id']}: {r['title']}\n    {f}:{r['lineStart']}\n    {r['evidence']}\n"
            if verbose:
                yield f"    {r['confidence']} confidence, {r['riskPoints']} points{', ' + r['mitre'] if r['mitre'] else ''}\n    {r['remediation']}\n"
    yield f"Score: {result['repoScore']}/100 ({result['scoreLabel'].upper()})\n"
    yield f"Threshold: {result['threshold']}\n" if "threshold" in result else ""
    yield f"Findings: {sum(n for _, n in counted)}" + "".join(f"  {s}: {n}" for s, n in counted if n) + "\n"
    yield "PASSED" if result["passed"] else "FAILED"
