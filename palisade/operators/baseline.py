"""Comparison with an earlier result, changed files, an incremental cache, and quality figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators.scoring import capped, label


def new_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose (rule, file) the baseline does not have; the line does not count."""
    return findings.join(baseline.select("path", "rule_id").distinct(), ["path", "rule_id"], "left_anti")


def resolved(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline rows whose (rule, file) is not found any more."""
    return baseline.join(findings.select("path", "rule_id").distinct(), ["path", "rule_id"], "left_anti")


def baseline_result(findings: DataFrame, baseline: DataFrame, threshold: int = 60) -> DataFrame:
    """One row for the files with new findings: their whole file scores count, and the label is that of the full result."""
    per = findings.groupBy("path").agg(F.sum("risk_points").alias("s"))
    full = per.agg(capped(F.sum("s")).alias("full"))
    kept = per.join(new_findings(findings, baseline).select("path").distinct(), "path", "left_semi").agg(capped(F.sum("s")).alias("repo_score"), F.count("*").alias("n_files"))
    # both sides are one aggregate row
    return kept.select("repo_score", "n_files", label(full.scalar()).alias("score_label"), (F.col("repo_score") < threshold).alias("passed"))


def changed_only(files: DataFrame, changed: DataFrame) -> DataFrame:
    return files.join(changed.select("path").distinct(), "path", "left_semi")


def cache_lookup(files: DataFrame, cache: DataFrame, signature: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their cached findings, files to scan): a hit has the same path, time and rule signature."""
    known = cache.where(F.col("signature") == signature).select("path", "mtime", "findings")
    hits = files.join(known, ["path", "mtime"]).select(*files.columns, "findings")
    return hits, files.join(known.select("path", "mtime"), ["path", "mtime"], "left_anti")


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, rule_id, line_start, change): what a re-scan added and removed."""
    key = ["path", "rule_id", "line_start"]
    a, b = before.select(*key).distinct(), after.select(*key).distinct()
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


def rule_quality(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(rule_id, tp, fp, fn, precision, recall, f1) from pairs (path, rule_id)."""
    both = expected.select("path", "rule_id").distinct().withColumn("e", F.lit(1)).join(found.select("path", "rule_id").distinct().withColumn("f", F.lit(1)), ["path", "rule_id"], "full_outer")
    n = both.groupBy("rule_id").agg(
        F.count_if(F.col("e").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn")
    )
    ratio = lambda a, b: F.when(b > 0, a / b)
    n = n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    p, r = F.col("precision"), F.col("recall")
    return n.withColumn("f1", F.when((p + r) > 0, 2 * p * r / (p + r)))


def file_quality(files: DataFrame, expected: DataFrame, found: DataFrame) -> DataFrame:
    """One row of file-level figures for files (path, is_safe) and pairs (path, rule_id) expected of the others and found.

    fp_rate: per cent of safe files with a finding; detection_rate: per cent of the expected pairs found. passed: no safe
    file has a finding and no pair is missed."""
    hit = found.select("path", "rule_id").distinct()
    safe = files.where("is_safe").select("path").distinct().join(hit.select("path").distinct().withColumn("hit", F.lit(1)), "path", "left")
    safe = safe.agg(F.count("*").alias("safe_files"), F.count("hit").alias("safe_fp_files"))
    pairs = expected.select("path", "rule_id").distinct().join(hit.withColumn("hit", F.lit(1)), ["path", "rule_id"], "left")
    pairs = pairs.agg(F.count("*").alias("expected_findings"), F.count("hit").alias("detected_findings"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(100 * F.col(a) / F.col(b), 1)).otherwise(F.lit(0.0))
    one = pairs.select(F.struct("*").alias("p")).scalar()
    return safe.withColumn("p", one).select("safe_files", "safe_fp_files", "p.*").select(
        "*", rate("safe_fp_files", "safe_files").alias("fp_rate"), rate("detected_findings", "expected_findings").alias("detection_rate"),
        ((F.col("safe_fp_files") == 0) & (F.col("detected_findings") == F.col("expected_findings"))).alias("passed"),
    )
