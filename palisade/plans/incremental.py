"""Incremental scans: files that are unchanged under the same rules keep their findings and directives.

The cache is a table in buckets of paths, in any store. A manifest names each bucket's current folder; a scan writes
the buckets of changed files anew, and no others, then the manifest, and only then removes the folders that it replaced.
So a scan that fails leaves the cache as it was."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.baseline import cache_lookup
from palisade.operators.suppress import MARKS, marks_of
from palisade.plans.scan import scan_rules, signature
from palisade.rules.catalogue import RULES
from palisade.rules.model import Rule
from palisade.sinks.documents import file_system
from palisade.sinks.tables import shared_dir, written

CACHE_FOLDER = ".palisade-cache"
FINDINGS = (
    "array<struct<rule_id:string,title:string,severity:string,confidence:string,category:string,mitre:string,remediation:string,line_start:int,line_end:int,"
    "evidence:string,risk_points:int,suppressed_by:int>>"
)
SHAPE = f"path string, mtime timestamp, signature string, findings {FINDINGS}, marks {MARKS}"


def cache_folder(spark: SparkSession, root: str) -> str:
    """Where the findings of the files under root are kept: beside them, but in the folder that all machines share where root is on one machine of a cluster."""
    if "://" in root:
        return f"{root.rstrip('/')}/{CACHE_FOLDER}"
    if spark.sparkContext.master.startswith("local"):
        return f"file://{root.rstrip('/')}/{CACHE_FOLDER}"
    return f"{shared_dir(spark)}/palisade-cache/{hashlib.sha256(root.encode()).hexdigest()[:16]}"


class FindingsCache:
    """Rows (path, mtime, signature, findings, marks), one a path, in buckets by a hash of the path."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.manifest = f"{self.folder}/manifest.json"

    def folders(self) -> dict[int, str]:
        """The current folder of each bucket that has rows."""
        store, place = file_system(self.spark, self.manifest)
        try:
            if not store.exists(place):
                return {}
            source = store.open(place)
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
            source.close()
        except Exception:  # a manifest that can't be read is none: the scan goes on without a cache
            return {}
        finally:
            store.close()
        return {int(k): v for k, v in told["folders"].items()} if told.get("buckets") == self.buckets else {}

    def read(self, only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/{v}/bucket={k}" for k, v in self.folders().items() if only is None or k in only]
        return self.spark.read.schema(SHAPE).parquet(*paths) if paths else self.spark.createDataFrame([], SHAPE)

    def replace(self, fresh: DataFrame) -> list[int]:
        """Puts the rows of fresh in place of those of the same paths; the buckets that were written."""
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")
        fresh = written(fresh.withColumn("bucket", bucket), "fresh-findings")
        hit = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())  # as many as buckets at most
        if not hit:
            return []
        old = self.read(hit).join(fresh.select("path"), "path", "left_anti").withColumn("bucket", bucket)
        version, before = uuid.uuid4().hex, self.folders()
        fresh.unionByName(old).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{version}")
        self._tell(before | dict.fromkeys(hit, version))
        for k in hit:
            self._remove(f"{before[k]}/bucket={k}" if k in before else None)
        for gone in set(before.values()) - set(self.folders().values()):
            self._remove(gone)
        return hit

    def _tell(self, folders: dict[int, str]) -> None:
        store, place = file_system(self.spark, self.manifest)
        new = file_system(self.spark, f"{self.manifest}.{uuid.uuid4().hex}")
        out = store.create(new[1], True)
        out.write(json.dumps({"buckets": self.buckets, "folders": folders}).encode())
        out.close()
        store.delete(place, False)
        store.rename(new[1], place)
        store.close()
        new[0].close()

    def _remove(self, name: str | None) -> None:
        if name:
            store, place = file_system(self.spark, f"{self.folder}/{name}")
            store.delete(place, True)
            store.close()


def scanned(files: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """files (path, mtime, content) as rows of the cache."""
    found = scan_rules(files.select("path", "content"), rules)
    own = [x.split(":")[0] for x in FINDINGS.removeprefix("array<struct<").removesuffix(">>").split(",")]
    per = found.groupBy("path").agg(F.collect_list(F.struct(*own)).cast(FINDINGS).alias("findings"))
    rows = files.select("path", "mtime", F.lit(signature(rules)).alias("signature"), marks_of(F.coalesce("content", F.lit(""))).alias("marks"))
    return rows.join(per, "path", "left").select("path", "mtime", "signature", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"), "marks")


def scan_incremental(keys: DataFrame, read: Callable[[list[str]], DataFrame], cache: FindingsCache, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Cache rows of the files that keys (path, mtime) tells. Only those without one are read, by read(paths), and scanned.

    The paths to read go through the driver, as a listing of files does; paths that are gone stay in the cache."""
    sig = signature(rules)
    _, rest = cache_lookup(keys, cache.read(), sig)
    paths = [r["path"] for r in rest.select("path").toLocalIterator()]
    if paths:
        cache.replace(scanned(read(paths), rules))
    return cache.read().where(F.col("signature") == sig).join(keys.select("path"), "path", "left_semi")
