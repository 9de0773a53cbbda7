"""One text file of any length from ordered rows: Spark sorts the rows by range and writes them as parts, and the
parts are joined at the file system. No row is a Python object on the driver, and none is held in memory there."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.sinks.tables import shared_dir


@dataclass(frozen=True)
class Document:
    """head, the values of rows in order of `by` with a line feed between them, and tail.

    Of the last value `drop` bytes are left out; without any row, `empty` stands between head and tail."""

    rows: DataFrame
    by: tuple
    head: str = ""
    tail: str = ""
    drop: int = 0
    empty: str = ""


def file_system(spark: SparkSession, path: str):
    """The store that path is in, and the path there; one without a scheme is on the driver's machine."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = jvm.org.apache.hadoop.fs.Path(path if "://" in path else "file://" + os.path.abspath(path))
    store = jvm.org.apache.hadoop.fs.FileSystem.newInstance(there.toUri(), conf)
    store.setWriteChecksum(False)
    return store, there


def write_document(document: Document, path: str) -> None:
    """Writes the document to path, over what is there."""
    spark = document.rows.sparkSession
    parts = f"{shared_dir(spark)}/palisade/document-{uuid.uuid4().hex}"
    document.rows.orderBy(*document.by).select("value").write.text(parts)
    store, there = file_system(spark, path)
    own, folder = file_system(spark, parts)
    out = store.create(there, True)
    try:
        _join(spark, document, own, folder, out)
    finally:
        out.close()
        own.delete(folder, True)
        store.close()
        own.close()


def _join(spark: SparkSession, document: Document, store, folder, out) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    # part files are numbered by range
    found = sorted((f.getPath().getName(), f.getLen(), f.getPath()) for f in store.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen())
    out.write(document.head.encode())
    for k, (_, size, part) in enumerate(found):
        # the last value's line feed goes, and what is to be dropped
        stay = size - (1 + document.drop if k == len(found) - 1 else 0)
        source = jvm.org.apache.hadoop.util.LimitInputStream(store.open(part), stay)
        try:
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
        finally:
            source.close()
    if not found:
        out.write(document.empty.encode())
    out.write(document.tail.encode())


def text_of(document: Document) -> str:
    """The document as a string, for short ones."""
    values = "\n".join(r["value"] for r in document.rows.orderBy(*document.by).select("value").collect())
    body = values.encode()[: -document.drop].decode() if values and document.drop else values
    return document.head + (body if values else document.empty) + document.tail


def collated(path: str = "path") -> tuple:
    """The order of files in reports: that of the Unicode collation, then of the characters' numbers."""
    return F.collate(F.col(path), "UNICODE"), F.col(path)


def each_value(rows: DataFrame, take: Callable[[str], None]) -> None:
    """Hands the values to a console, a partition at a time."""
    for r in rows.select("value").toLocalIterator():
        take(r["value"])
