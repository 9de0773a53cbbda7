"""Connected components of a graph of 64-bit nodes, as Spark jobs.

Alternating large-star and small-star steps (each an aggregation for the smallest neighbour and a
join back), written to the shared folder after each round until the edges no longer change. A round
moves a bounded number of rows per edge; a node with very many neighbours is aggregated map-side,
and its least neighbour is broadcast to them; `join_uneven` bounds how many such nodes there can be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import join_uneven, written


def _stars(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges (a, b) with a > b; both ways they are `total` at most. Large star links larger neighbours, small star the smaller ones, to the least."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        return join_uneven(both.where(F.col("b") > F.col("a")), least, "a", total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_uneven(edges, least, "a", total).where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the component's smallest node. Loops and repeats are allowed."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now, state = written(now, "edges"), None
    while True:  # ends: roots only get smaller, and stars of one level stay
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == state or not sign[0]:
            break
        state = sign
        now = written(_stars(_stars(now, True, 2 * sign[0]), False, 2 * sign[0]), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
