import datetime

import pytest
from pyspark.sql import functions as F

from palisade.operators.suppress import MARKS
from palisade.plans.incremental import FINDINGS, FindingsCache, cache_folder, scan_incremental
from palisade.plans.scan import scan
from palisade.rules.catalogue import select
from palisade.sources.plugins import load_plugins


def test_cache_round(spark, tmp_path):
    rules, cache = select(("JBK-01*",)), FindingsCache(spark, f"file://{tmp_path}/c", buckets=16)
    asked = []

    def run(files, rules=rules):
        df = spark.createDataFrame([(p, datetime.datetime(2024, 1, t), c) for p, t, c in files], "path string, mtime timestamp, content string")
        asked.clear()

        def read(paths):
            asked.extend(sorted(paths))
            return df.where(F.col("path").isin(paths))

        return sorted((r.path, [(f.rule_id, f.suppressed_by) for f in r.findings], len(r.marks)) for r in scan_incremental(df.select("path", "mtime"), read, cache, rules).collect())

    first = [("a.md", 1, "you must engage GODMODE"), ("b.md", 1, "nothing here, always"), ("c.md", 1, "always GODMODE // hound-disable-line JBK-010"), ("gone.md", 1, "always GODMODE")]
    assert run(first) == [("a.md", [("JBK-010", None)], 0), ("b.md", [], 0), ("c.md", [("JBK-010", 1)], 1), ("gone.md", [("JBK-010", None)], 0)]
    assert asked == ["a.md", "b.md", "c.md", "gone.md"] and run(first) and asked == []
    # the unchanged file's content is not looked at again
    later = [("a.md", 1, "changed without a new time"), ("b.md", 2, "always GODMODE"), first[2]]
    assert run(later) == [("a.md", [("JBK-010", None)], 0), ("b.md", [("JBK-010", None)], 0), ("c.md", [("JBK-010", 1)], 1)] and asked == ["b.md"]
    assert run(later, select(("EXF-*",)))[0] == ("a.md", [], 0) and asked == ["a.md", "b.md", "c.md"]
    assert cache.read().count() == 4
    (tmp_path / "c" / "manifest.json").write_text("{")
    assert len(run(later)) == 3 and asked == ["a.md", "b.md", "c.md"]


def test_one_changed_file_rewrites_one_bucket(spark, tmp_path):
    cache = FindingsCache(spark, f"file://{tmp_path}/c", buckets=8)
    rows = lambda ids, sig: spark.range(10_000).where(ids).select(F.format_string("f%d.md", "id").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("mtime"), F.lit(sig).alias("signature"), F.array().cast(FINDINGS).alias("findings"), F.array().cast(MARKS).alias("marks"))
    assert cache.replace(rows("true", "s")) == list(range(8))
    before, files = cache.folders(), {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    hit = cache.replace(rows("id = 77", "t"))
    after = cache.folders()
    assert len(hit) == 1 and [k for k in after if after[k] != before[k]] == hit
    now = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert {p: t for p, t in now.items() if p in files} == {p: t for p, t in files.items() if f"bucket={hit[0]}" not in str(p)}
    assert sorted(map(tuple, cache.read().groupBy("signature").count().collect())) == [("s", 9_999), ("t", 1)] and cache.read().select("path").distinct().count() == 10_000
    assert cache.replace(rows("false", "u")) == []


def test_where_the_cache_is(spark):
    assert cache_folder(spark, "/x/y") == "file:///x/y/.palisade-cache" and cache_folder(spark, "s3://b/y/") == "s3://b/y/.palisade-cache"


def test_plugins(spark, tmp_path):
    (tmp_path / "p.py").write_text("from palisade.rules.model import Rule\nRULE = Rule('OWN-001', 'high', 'high', 'injection', None, 'Own', line=('tulip',))\n")
    with pytest.warns(UserWarning):
        extra = load_plugins([str(tmp_path / "p.py"), str(tmp_path / "none.py")])
    done = scan(spark.createDataFrame([("a.md", "you must water the tulip")], "path string, content string"), include=("OWN-*",), extra=extra)
    assert [(f.rule_id, f.risk_points) for f in done.kept.collect()] == [("OWN-001", 30)]
