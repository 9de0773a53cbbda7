"""Sharding by jump consistent hashing.

A row's shard depends on its key and the number of shards alone: the key seeds a generator whose
draws are the shard counts at which the row jumps to a new shard, and the last jump below the number
of shards is its shard. No ring table is kept, and one more shard takes 1 row in n + 1, all into itself.
Keys are hashed by the first 64 bits of their MD5, so the placement is the same in any other system.

Slots number the rows of a shard from 0 without gaps, in order of a hash of (key, checksum, size); so
they depend on the rows alone, not on files or tasks. Rows equal in all three are counted before the
shuffle and numbered in chunks, so repeated rows, also of a null key, load no single task; buckets by
the leading bits of the hash hold about equally many rows, and only their sizes are summed up.

A null key is a key like any other; a null text has no bytes and checksum 0. Rows tied on everything get
neighbouring slots. Very long texts only count by their size. An empty table gives no rows. Extra columns
don't matter to `placements` and are kept by `write_shards`, whose own columns must not exist.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import written

#: Rows of a bucket, on average; copies of one row that a task numbers.
BUCKET_ROWS, CHUNK = 20_000, 10_000
MULTIPLIER = np.uint64(2862933555777941757)  # of the published algorithm


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key among so many shards."""
    out, open_, key, to = np.zeros(len(keys), np.int64), np.arange(len(keys)), keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    while len(open_):
        out[open_] = to
        key = key * MULTIPLIER + np.uint64(1)
        to = ((to + 1) * (float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        stays = to < shards
        open_, key, to = open_[stays], key[stays], to[stays]
    return out


def key_hash(key: Column) -> Column:
    """Eight bytes that stand for a key."""
    return F.unhex(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 16))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a key, from 0. Only eight bytes a row go to Python."""
    if not 1 <= shards < 1 << 31:
        raise ValueError("shards must be from 1 to 2147483647")

    @F.pandas_udf("int")
    def to_shard(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(np.frombuffer(b"".join(hashes), ">u8"), shards), dtype="int32")

    return to_shard(key_hash(key))


def placements(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) of each row: size is the text's UTF-8 bytes and one, grown_shard the shard among one more."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(docs[key].alias("key"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = rows.withColumns({"shard": jump_shard(F.col("key"), shards), "grown_shard": jump_shard(F.col("key"), shards + 1)})
    mark = F.md5(F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("text_crc32").cast("string"), F.col("size").cast("string")).cast("binary"))
    same = written(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")).withColumn("mark", F.substring(mark, 1, 16)), "placements")
    bits = min(24, max(0, math.ceil(math.log2(max(1, same.count()) / (shards * BUCKET_ROWS)))))
    bucket = F.shiftright(F.conv(F.substring("mark", 1, 6), 16, 10).cast("int"), 24 - bits)
    same = same.withColumn("bucket", bucket)
    sizes = same.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("shard", "bucket").orderBy("mark", "key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = same.join(begins, ["shard", "bucket"]).withColumn("slot", F.col("begin") + F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    out = lambda df, offset: df.select("key", "size", "text_crc32", "shard", (F.col("slot") + offset).alias("slot"), "grown_shard")
    few = first.where(F.col("copies") <= CHUNK).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    # chunks of a row with very many copies are dealt to tasks before they are written out
    many = first.where(F.col("copies") > CHUNK).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(CHUNK).cast("long"))))
    many = many.repartition("mark", "from").withColumn("i", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK, F.col("copies")) - 1)))
    return out(few, F.col("i")).unionByName(out(many, F.col("i")))


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id", files: int = 1) -> None:
    """All rows as Parquet under path/shard=N, in about so many files a shard. A row's file follows from a hash of the whole row, so no key fills one file."""
    if {"shard", "__file"} & set(docs.columns):
        raise ValueError("the columns shard and __file must not exist")
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    file = F.pmod(F.xxhash64(*(docs[c] for c in plain)), F.lit(files))
    out = docs.withColumns({"shard": jump_shard(docs[key], shards), "__file": file}).repartition(shards * files, "shard", "__file")
    out.drop("__file").write.partitionBy("shard").parquet(path)
