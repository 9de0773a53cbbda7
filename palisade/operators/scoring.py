"""File and repository scores, labels and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.sinks.documents import collated
from palisade.sinks.tables import written

SEVERITY_FAILS = {"critical": ("critical",), "high": ("critical", "high"), "medium": ("critical", "high", "medium")}


#: Below which score each label holds.
LABELS = ((30, "low"), (60, "medium"), (80, "high"))


def label(score: Column) -> Column:
    out = F.lit("critical")
    for below, name in reversed(LABELS):
        out = F.when(score < below, name).otherwise(out)
    return out


def label_of(score: int) -> str:
    return next((name for below, name in LABELS if score < below), "critical")


def file_scores(findings: DataFrame, key: str = "path") -> DataFrame:
    return findings.groupBy(key).agg(F.sum("risk_points").alias("file_score"), F.count("*").alias("n_findings"))


def capped(points: Column) -> Column:
    return F.least(F.lit(100), F.coalesce(points, F.lit(0))).cast("int")


def repo_result(findings: DataFrame, threshold: int = 60, fail_on: str | None = None, fail_file_threshold: int | None = None) -> DataFrame:
    """One row: repo_score, score_label, n_findings, max_file_score, breaches and passed. Partial sums by file first."""
    per = findings.groupBy("path").agg(
        F.sum("risk_points").alias("s"), F.count("*").alias("n"), F.bool_or(F.col("severity").isin(*SEVERITY_FAILS.get(fail_on, ()))).alias("hit")
    )
    row = per.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("s").alias("most"), F.bool_or("hit").alias("hit"))
    score = capped(F.col("s"))
    breached = F.lit(False) if fail_file_threshold is None else F.coalesce(F.col("most") >= fail_file_threshold, F.lit(False))
    severe = F.coalesce(F.col("hit"), F.lit(False))
    return row.select(
        score.alias("repo_score"), label(score).alias("score_label"), F.coalesce("n", F.lit(0)).alias("n_findings"), F.coalesce("most", F.lit(0)).alias("max_file_score"),
        severe.alias("fail_on_hit"), breached.alias("file_threshold_breached"), ((score < threshold) & ~severe & ~breached).alias("passed"),
    )


def exit_code(passed: bool, fail_on_hit: bool) -> int:
    return 0 if passed else 3 if fail_on_hit else 2


def first_files(findings: DataFrame, most: int) -> DataFrame:
    """Findings of the files, in the order of reports, before which fewer than `most` findings stand; 0 takes all.

    The running sum goes over one row a file, in ranges of paths, so no task holds all files."""
    if not most:
        return findings
    from pyspark.sql import Window as W

    per = findings.groupBy("path").agg(F.count("*").alias("n")).repartitionByRange(*collated()).withColumn("part", F.spark_partition_id())
    # written down, so that both uses see the same numbers of ranges
    per = written(per, "files-by-path")
    parts = per.groupBy("part").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", before.alias("before"))
    own = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy(*collated()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = per.withColumn("own", own).join(F.broadcast(offsets), "part").where(F.col("own") + F.col("before") < most).select("path")
    return findings.join(kept, "path", "left_semi")
