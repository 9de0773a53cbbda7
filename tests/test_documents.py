"""Reports written by Spark, against the same reports made by plain code from a list of findings."""

import csv
import html
import io
import json
import xml.dom.minidom
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from palisade.sinks import reports
from palisade.sinks.documents import Document, text_of, write_document
from palisade.sources import files as src

RESULT = {"repoScore": 7, "scoreLabel": "low", "threshold": 60, "passed": True, "suppressedCount": 2}
SHAPE = "path string, rule_id string, title string, severity string, confidence string, evidence string, line_start int, line_end int, remediation string, risk_points int, mitre string"
NAMES = dict(zip("id title severity confidence evidence file lineStart lineEnd remediation riskPoints mitre".split(), "rule_id title severity confidence evidence path line_start line_end remediation risk_points mitre".split(), strict=True))
#: In the order of the Unicode collation.
PATHS = ["_x.md", "a/b.md", "a/B.md", "a/c.md", "é.md", "Z.md"]


@pytest.fixture(scope="module")
def findings(spark):
    odd = ['a "quoted"\\ one', "tab\tand\x0b\x1f\x07 line\nfeed", "é \U0001f600 </script> & <b> 'x' | y", "", ", comma"]
    rows = [(p, f"R-{k % 4}", f"t|{k % 4} <é>", ("low", "critical", "high", "medium")[k % 4], "low", odd[k % 5], k % 7, k % 7 + 1, 'fix "it"', k + 1, "T1.002" if k % 4 else None) for p in PATHS for k in range(11)]
    rows = list({(r[0], r[1], r[6]): r for r in rows}.values())
    return spark.createDataFrame(rows, SHAPE).repartition(5)


def plain(findings):
    rows = [r.asDict() for r in findings.collect()]
    rows.sort(key=lambda r: (PATHS.index(r["path"]), r["line_start"], r["rule_id"]))
    return [{k: r[c] for k, c in NAMES.items() if r[c] is not None} for r in rows]


def per_file(rows):
    out = {}
    for r in rows:
        out.setdefault(r["file"], []).append(r)
    return out.items()


def test_json(findings):
    rows = plain(findings)
    files = [{"file": f, "findings": own, "fileScore": sum(r["riskPoints"] for r in own)} for f, own in per_file(rows)]
    assert text_of(reports.json_report(RESULT, findings)) == json.dumps(RESULT | {"files": files, "allFindings": rows}, indent=2, ensure_ascii=False)
    scored = findings.withColumn("file_score", F.lit(99))
    assert {f["fileScore"] for f in json.loads(text_of(reports.json_report(RESULT, scored)))["files"]} == {99}


def test_lines(findings):
    rows = plain(findings)
    assert [json.loads(x) for x in text_of(reports.jsonl(findings)).split("\n")] == rows
    out = io.StringIO()
    fields = list(reports.CSV_COLUMNS.values())
    csv.writer(out, lineterminator="\n").writerows([list(reports.CSV_COLUMNS), *([r.get(f, "") for f in fields] for r in rows)])
    assert text_of(reports.csv(findings)) == out.getvalue()[:-1]


def test_sarif(findings):
    rows = plain(findings)
    got = text_of(reports.sarif(findings))
    body = json.loads(got)
    assert got == json.dumps(body, indent=2, ensure_ascii=False)
    assert [r["ruleId"] for r in body["runs"][0]["results"]] == [r["id"] for r in rows] and len(body["runs"][0]["tool"]["driver"]["rules"]) == 4
    one = body["runs"][0]["results"][3]
    assert one["message"]["text"] == f"{rows[3]['title']}: {rows[3]['evidence']}" and one["locations"][0]["physicalLocation"]["region"] == {"startLine": rows[3]["lineStart"], "endLine": rows[3]["lineEnd"]}


def test_junit(findings):
    rows, x = plain(findings), lambda s: escape(str(s), {'"': "&quot;", "'": "&apos;"})
    out = ['<?xml version="1.0" encoding="UTF-8"?>', f'<testsuites name="palisade" tests="{len(rows)}" failures="{len(rows)}" errors="0" time="0">']
    for f, own in per_file(rows):
        out.append(f'  <testsuite name="{x(f)}" tests="{len(own)}" failures="{len(own)}" errors="0" time="0">')
        for r in own:
            tag = f"\nMITRE ATT&CK: {r['mitre']}" if "mitre" in r else ""
            told = f"File: {f}\nLine: {r['lineStart']}\nEvidence: {r['evidence']}{tag}\nRemediation: {r['remediation']}"
            out += [f'    <testcase name="{x(r["id"] + ": " + r["title"])}" classname="{x(f)}" time="0">', f'      <failure message="{x(r["id"])} [{r["severity"]}]: {x(r["title"])}" type="{r["severity"]}">{x(told)}</failure>', "    </testcase>"]
        out.append("  </testsuite>")
    assert text_of(reports.junit(findings)) == "\n".join([*out, "</testsuites>"])


def test_markdown_and_html(findings):
    rows = plain(findings)
    text = text_of(reports.markdown(RESULT, findings))
    assert text.startswith("# Palisade report ![PASSED](") and [x for x in text.split("\n") if x.startswith("### `")] == [f"### `{f}`" for f, _ in per_file(rows)]
    assert text.count("<details>") == len(rows) and f"**Total findings:** {len(rows)}" in text and r"t\|1" in text and html.escape("t|1 <é>") in text
    page = text_of(reports.html_page(RESULT, findings))
    data = page.split("id='data'>")[1]
    assert data.count("</script>") == 1 and json.loads(data.removesuffix("</script>"))["findings"] == rows
    assert page.count("<tr>") == len(rows) and html.escape(rows[1]["evidence"]) in page


def test_without_findings(findings):
    none = findings.where("false")
    assert json.loads(text_of(reports.json_report(RESULT, none))) == RESULT | {"files": [], "allFindings": []}
    assert text_of(reports.csv(none)) == reports.CSV_HEADER and text_of(reports.jsonl(none)) == ""
    assert json.loads(text_of(reports.sarif(none)))["runs"][0]["results"] == []
    xml.dom.minidom.parseString(text_of(reports.junit(none)))
    assert json.loads(text_of(reports.html_page(RESULT, none)).split("id='data'>")[1].removesuffix("</script>"))["findings"] == []
    assert "Findings by File" not in text_of(reports.markdown(RESULT, none))


def test_written_as_it_is_read(spark, findings, tmp_path):
    path = str(tmp_path / "out.txt")
    for document in (reports.json_report(RESULT, findings), reports.csv(findings), reports.jsonl(findings), reports.junit(findings), reports.sarif(findings.where("false")), reports.markdown(RESULT, findings)):
        write_document(document, path)  # over what is there
        with open(path, encoding="utf-8", newline="") as f:
            assert f.read() == text_of(document)
    assert [p.name for p in tmp_path.iterdir()] == ["out.txt"]
    write_document(Document(spark.range(0).select(F.lit("x").alias("value")), ("value",), "a", "c", 1, "b"), path)
    assert open(path).read() == "abc"


def test_no_row_is_fetched(spark, findings, tmp_path, monkeypatch):
    """Rows of a report never become Python objects on the driver: only counts do, a few at a time."""
    from pyspark.sql.classic.dataframe import DataFrame

    got = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: got.append(collect(self)) or got[-1])
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    for make in (lambda: reports.json_report(RESULT, findings), lambda: reports.sarif(findings), lambda: reports.junit(findings), lambda: reports.csv(findings)):
        write_document(make(), str(tmp_path / "x"))
    assert max((len(x) for x in got), default=0) <= 4


def test_many_findings(spark, tmp_path):
    """More findings than any page held, in several parts."""
    n = 25_000
    kept = spark.range(n).select(
        F.format_string("f%05d.md", (F.col("id") / 2).cast("int")).alias("path"), F.format_string("R-%d", F.col("id") % 2).alias("rule_id"), F.lit("t").alias("title"), F.lit("high").alias("severity"),
        F.lit("low").alias("confidence"), F.lit("a\nb").alias("evidence"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit("r").alias("remediation"), F.lit(7).alias("risk_points"), F.lit(None).cast("string").alias("mitre"),
    )
    path = tmp_path / "b.json"
    write_document(reports.json_report(RESULT, kept), str(path))
    text = path.read_text()
    body = json.loads(text)
    assert text == json.dumps(body, indent=2, ensure_ascii=False) and [(r["file"], r["id"]) for r in body["allFindings"]] == [(f"f{k // 2:05d}.md", f"R-{k % 2}") for k in range(n)]
    assert len(body["files"]) == n // 2 and {f["fileScore"] for f in body["files"]} == {14}
    reports.json_lines(kept).select("value").write.text(str(tmp_path / "rows"))
    kept.write.parquet(str(tmp_path / "table"))
    for name in ("b.json", "rows", "table"):
        assert src.read_baseline(spark, str(tmp_path / name)).count() == n
    assert f"Findings: {n}  high: {n}" in "".join(reports.console_lines(RESULT, kept))
