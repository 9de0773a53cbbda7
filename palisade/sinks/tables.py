"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-palisade-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, as in tests, a fresh temporary one if Spark runs in one process; on a cluster that would be lost."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = _own_dir()
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, safe when an executor goes. It is deleted when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palisade/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    sc = spark.sparkContext
    there = sc._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)
