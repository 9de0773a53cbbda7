"""Texts are dealt in parts of bounded size, as the work on a text takes far longer than moving it."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Input up to so many bytes for each core is dealt in two parts for each core at least.
SPREAD_BYTES = 32 << 20
#: A part has at most about so many bytes, as Spark's plan tells them, whatever the sizes of files and their row groups.
PART_BYTES = 4 << 20
#: So many parts at most: of still larger input each part is larger.
MOST_PARTS = 20_000
#: Spark tells such a size of what it cannot know, as of rows that Python made.
UNKNOWN = (1 << 63) - 1


def spread(df: DataFrame) -> DataFrame:
    """df in parts of PART_BYTES by the size that Spark's plan tells; if that is small, in twice as many as there are cores at least. Of unknown size it stays."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if max(read) >= UNKNOWN:
        return df
    # a join's size is told as a product; what is read bounds it well enough
    size = min(int(str(plan.stats().sizeInBytes())), sum(read))
    parts = min(-(-size // PART_BYTES), MOST_PARTS)
    if size <= cores * SPREAD_BYTES:
        parts = max(parts, 2 * cores)
    return df.repartition(parts) if parts > 1 else df
