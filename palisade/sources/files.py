"""Sources: files in any store Spark reads, tables of texts, configuration and earlier results."""

from __future__ import annotations

import json
import os
import re
import subprocess
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.sources.globs import Wanted, listed, local_entries, store_entries

#: What is scanned by default.
INCLUDE = ("**/*.md", "**/*.txt", "**/*.yaml", "**/*.yml", "**/*.json", "**/*.ts", "**/*.js", "**/*.prompt", "**/*.prompt.*")
EXCLUDE = ("**/node_modules/**", "**/dist/**", "**/build/**", "**/.git/**", "**/coverage/**", "**/*.min.js", "**/package-lock.json", "**/yarn.lock", "**/pnpm-lock.yaml")
DEFAULTS = {"threshold": 60, "failFileThreshold": None, "baseline": None, "cache": True, "plugins": [], "verbose": False, "maxFindings": 0, "failOn": None, "minConfidence": None, "includeRules": [], "excludeRules": [], "include": list(INCLUDE), "exclude": list(EXCLUDE)}
ENVIRONMENT = {"PALISADE_THRESHOLD": ("threshold", int), "PALISADE_FAIL_ON": ("failOn", str), "PALISADE_MIN_CONFIDENCE": ("minConfidence", str), "PALISADE_VERBOSE": ("verbose", lambda v: v == "true")}
#: Fixed value: the ignore file, as existing projects have it; the configuration file and the environment's names are our own.
IGNORE_FILE, CONFIG_FILE = ".houndignore", ".palisaderc.json"


def read_files(spark: SparkSession, root: str, include=INCLUDE, exclude=EXCLUDE) -> DataFrame:
    """(path, mtime, content) of the files under root that the globs take (globs.py has what they may hold)."""
    return read_paths(spark, root, list_paths(spark, root, include, exclude))


def absolute(root: str) -> str:
    """root without a last slash; on this machine as a plain path."""
    root = re.sub(r"^file:/*", "/", root)
    return os.path.abspath(root) if "://" not in root else root.rstrip("/")


def list_paths(spark: SparkSession, root: str, include=INCLUDE, exclude=EXCLUDE) -> list[str]:
    """The wanted paths under root, listed on the driver as Spark lists files; folders in which nothing can be wanted are not."""
    base = absolute(root)
    entries = local_entries(base) if "://" not in base else store_entries(spark, base)
    return list(listed(entries, Wanted(include, exclude)))


def read_paths(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(path, mtime, content) of these files under root, read by tasks; without content, only their times are looked up."""
    base = absolute(root)
    if not paths:
        return spark.createDataFrame([], "path string, mtime timestamp, content string")
    # the characters of Hadoop's own globs stand for themselves here
    scheme, paths = "" if "://" in base else "file://", [f"{base}/{p}" for p in paths]
    raw = spark.read.format("binaryFile").load([scheme + re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths])
    start = re.sub(r"^\w+:/*", "/", base) + "/"
    path = F.regexp_replace("path", r"^\w+:/*", "/")
    rel = F.when(path.startswith(start), F.substring(path, len(start) + 1, 1 << 20)).otherwise(path)
    return raw.select(rel.alias("path"), F.col("modificationTime").alias("mtime"), F.expr("make_valid_utf8(cast(content as string))").alias("content"))


def read_table(df: DataFrame, path, content: str = "text") -> DataFrame:
    """(path, content) of a table of texts; null texts are empty."""
    return df.select(path.alias("path"), F.coalesce(F.col(content), F.lit("")).alias("content"))


def read_ignore(folder: str) -> list[str]:
    try:
        with open(os.path.join(folder, IGNORE_FILE)) as f:
            return [x for x in map(str.strip, f) if x and not x.startswith("#")]
    except OSError:
        return []


def load_config(path: str | None = None, overrides: dict | None = None, warn=warnings.warn) -> dict:
    """Defaults, then the file, then the environment, then overrides; a broken file counts as none and is told of."""
    out = dict(DEFAULTS)
    named = path or os.environ.get("PALISADE_CONFIG")
    try:
        with open(named or CONFIG_FILE) as f:
            out |= {k: v for k, v in json.load(f).items() if k not in ("diff", "reportUnusedSuppressions")}
    except (OSError, ValueError, AttributeError) as err:
        if named or not isinstance(err, FileNotFoundError):
            warn(f"configuration {named or CONFIG_FILE} could not be read: {err}")
    out |= {key: kind(os.environ[name]) for name, (key, kind) in ENVIRONMENT.items() if name in os.environ}
    return out | {k: v for k, v in (overrides or {}).items() if v is not None}


def changed_paths(folder: str, ref: str = "origin/main") -> list[str] | None:
    """Paths that git tells as changed or new, or None where it cannot."""
    out: list[str] = []
    for args in (["diff", "--name-only", ref], ["ls-files", "--others", "--exclude-standard"]):
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True)
        if done.returncode:
            return None
        out += done.stdout.split("\n")
    return sorted({x for x in out if x})


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(path, rule_id) of an earlier result: a JSON report, a jsonl report, or a Parquet table of findings."""
    first = spark.read.text(path).limit(1).select(F.col("value").startswith("PAR1").alias("parquet"), F.get_json_object("value", "$.id").isNotNull().alias("row")).first()
    if first is not None and first["parquet"]:
        return spark.read.parquet(path).select("path", "rule_id")
    if first is None or first["row"]:
        return spark.read.schema("id string, file string").json(path).select(F.col("file").alias("path"), F.col("id").alias("rule_id"))
    shape = "allFindings array<struct<id:string,file:string>>"
    return spark.read.schema(shape).json(path, multiLine=True).select(F.explode("allFindings").alias("f")).select(F.col("f.file").alias("path"), F.col("f.id").alias("rule_id"))
