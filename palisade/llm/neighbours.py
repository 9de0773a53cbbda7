"""Approximate nearest neighbours: stable projections in a kd-tree, verified until a chi-square test holds.

Largest inner product is turned into smallest distance by one more coordinate that gives every vector
the largest norm of all. A Gaussian (2-stable) projection takes vectors to few dimensions: the
squared projected distance over the squared true one is chi-square with that many degrees of freedom.

The projected points are indexed by one kd-tree. Its top is split at the medians of at most SAMPLE points
and ends in cells of about CELL vectors; below, each cell is a tree of its own, built once by a task and
written. Every vector is indexed. Equal vectors are one entry with its smallest ids: a query takes at most k of them, so no more
than k + 1 different ones, each up to k times, can ever be told.

A query walks the tree by increasing projected distance: nodes wait in a queue, a node's far side stands at the
distance that its splitting plane adds. Vectors of the leaves that come up are verified exactly. The walk stops
when, for the distance of the k-th best so far, a vector beyond the next node would be closer with
probability less than 1 - CONFIDENCE. Over cells this takes rounds: the nearest cell first, then FAN times as many each round,
of which only those that pass the test are asked, with the k-th best so far. Queries of a cell are dealt to
tasks of about ASKED queries.

Vectors that are null, zero or hold null or non-finite components take no part. Vectors of unlike
length are never compared. A vec_id given twice takes part each time, but no row of the query's own
vec_id is a candidate; a vec_id with several vectors is a query for each, with ranks of its own. A null vec_id is no query and no
candidate. Ties go to the smaller vec_id. Fewer candidates than k: all come. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.llm.common import written

#: In 64 dimensions of little structure, CONFIDENCE 0.4 found 0.99 of the true neighbours (README).
K, DIMS, LEAF, CONFIDENCE = 20, 8, 128, 0.4
#: Vectors of a cell on average, points that place the tree's top, queries of a task on average.
CELL, SAMPLE, ASKED = 16_384, 65_536, 512
#: Vectors verified between two stopping tests; growth of the number of cells from round to round.
VERIFIED, FAN = 1024, 8


def chi_square_cdf(x: float, dims: int = DIMS) -> float:
    """For an even number of degrees of freedom."""
    h = x / 2
    return 1 - math.exp(-h) * sum(h**i / math.factorial(i) for i in range(dims // 2)) if h < 700 else 1.0


class Projection:
    """Vectors of one length, lifted to the norm of the longest, in DIMS dimensions."""

    def __init__(self, length: int, norm: float, dims: int = DIMS, seed: int = 11):
        self.norm, self.dims = norm, dims
        self.matrix = np.random.default_rng([seed, length]).normal(size=(length + 1, dims))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(0, self.norm**2 - (vectors**2).sum(axis=1)))
        return vectors @ self.matrix[:-1] + lift[:, None] * self.matrix[-1]

    def of_query(self, query: np.ndarray) -> np.ndarray:
        """At the data's norm: the order of inner products is then that of distances."""
        return (query * (self.norm / math.sqrt(query @ query))) @ self.matrix[:-1]

    def distance(self, score: float, query: np.ndarray) -> float:
        """Squared distance, to the query at that norm, of a vector with this inner product."""
        return max(1e-12, 2 * self.norm**2 - 2 * score * self.norm / math.sqrt(query @ query))


class Tree:
    """A kd-tree split at medians of the widest dimension: node i has children 2 i + 1 and 2 i + 2."""

    def __init__(self, points: np.ndarray, depth: int):
        inner = (1 << depth) - 1
        self.depth, self.dim, self.at = depth, np.zeros(inner, np.int8), np.zeros(inner)
        parts = [np.arange(len(points))]
        for i in range(inner):
            own = points[parts[i]]
            if len(own):
                self.dim[i] = np.argmax(own.max(axis=0) - own.min(axis=0))
                x = own[:, self.dim[i]]
                self.at[i] = np.partition(x, len(x) // 2)[len(x) // 2]
            right = own[:, self.dim[i]] >= self.at[i]
            parts += [parts[i][~right], parts[i][right]]
        self.parts = parts[inner:]

    def __getstate__(self):
        return self.depth, self.dim, self.at

    def __setstate__(self, state):
        self.depth, self.dim, self.at = state

    def leaf(self, points: np.ndarray) -> np.ndarray:
        """The number, from 0, of the leaf that each point falls in."""
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.dim[node]] >= self.at[node])
        return node - len(self.dim)

    def walk(self, point: np.ndarray):
        """(squared distance, leaf) by increasing distance of the leaves' regions, found as they are asked for."""
        p, dim, at, inner = point.tolist(), self.dim.tolist(), self.at.tolist(), len(self.dim)
        heap = [(0.0, 0, (0.0,) * len(p))]
        while heap:
            far, node, sides = heapq.heappop(heap)
            if node >= inner:
                yield far, node - inner
                continue
            d = dim[node]
            gap = p[d] - at[node]
            near = 2 * node + (2 if gap >= 0 else 1)
            beyond = max(gap * gap, sides[d])
            heapq.heappush(heap, (far, near, sides))
            heapq.heappush(heap, (far - sides[d] + beyond, 4 * node + 3 - near, (*sides[:d], beyond, *sides[d + 1 :])))


def _levels(n: int, size: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n / size))))


class CellIndex:
    """A cell's vectors in the order of its tree's leaves, each with its ids."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], projection: Projection):
        low = projection.of(vectors)
        self.low, self.high = low.min(axis=0), low.max(axis=0)
        self.tree = Tree(low, _levels(len(low), LEAF))
        order = np.concatenate(self.tree.parts)
        self.bounds = np.concatenate([[0], np.cumsum([len(p) for p in self.tree.parts])])
        self.vectors, own = vectors[order], [ids[i] for i in order]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        self.ids = np.concatenate(own)

    def search(self, query_id: int, query: np.ndarray, projection: Projection, k: int, confidence: float, least: float):
        """(ids, scores) of the k best found that reach `least`, best first, ties to the smaller id. least is the k-th best found elsewhere, or -inf."""
        ids, scores, seen = np.empty(0, np.int64), np.empty(0), VERIFIED
        for far, leaf in self.tree.walk(projection.of_query(query)):
            if seen >= VERIFIED:
                if least > -math.inf and chi_square_cdf(far / projection.distance(least, query), projection.dims) >= confidence:
                    break
                seen = 0
            a, b = self.bounds[leaf], self.bounds[leaf + 1]
            if a == b:
                continue
            seen += b - a
            new = self.vectors[a:b] @ query
            own = self.ids[self.first[a] : self.first[b]]
            if len(own) > b - a:
                new = np.repeat(new, np.diff(self.first[a : b + 1]))
            take = (own != query_id) & (new >= least)
            if take.any():
                order = np.lexsort((np.concatenate([ids, own[take]]), -np.concatenate([scores, new[take]])))[:k]
                ids, scores = np.concatenate([ids, own[take]])[order], np.concatenate([scores, new[take]])[order]
                if len(ids) == k:
                    least = max(least, scores[-1])
        return ids, scores


def usable(df: DataFrame, vector: str) -> DataFrame:
    """(vec_id, v, d): the vectors that take part, as doubles, with their length."""
    v = F.col(vector).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(good).withColumn("d", F.size("v"))


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """(d, v, ids) of each different vector: its k + 1 smallest ids, each as often as it comes, up to k times.

    The limit is applied in each task before the shuffle, so a vector that a third of all rows share sends few rows."""
    per = rows.groupBy("d", "v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    near = per.withColumn("r", F.row_number().over(W.partitionBy("d", "v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ids = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "n"))), lambda x: F.array_repeat(x["vec_id"], x["n"])))
    return near.groupBy("d", "v").agg(ids.alias("ids"))


def _tops(entries: DataFrame):
    """For each length of vectors its projection and the top of its tree; as many as there are lengths."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = {r["d"]: (r["n"], r["norm"]) for r in entries.groupBy("d").agg(F.count("*").alias("n"), F.max(norm).alias("norm")).collect()}
    total = sum(n for n, _ in sizes.values())
    share = min(1.0, SAMPLE / max(1, total))
    some = entries.select("d", "v").where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(2 * SAMPLE).toPandas()
    out = {}
    for d, (n, norm) in sizes.items():
        projection = Projection(d, norm)
        own = some.loc[some["d"] == d, "v"]
        points = projection.of(np.stack(own.to_numpy())) if len(own) else np.zeros((0, DIMS))
        out[d] = projection, Tree(points, _levels(n, CELL) if len(own) else 0)
    return out


def build_index(entries: DataFrame, tops) -> DataFrame:
    """(block, d, low, high, data): a row for each cell, or part of a cell that holds far more than others."""

    def celled(batches):
        for b in batches:
            d, v = b["d"].to_numpy(), b["v"].to_pylist()
            cell = np.zeros(len(d), np.int32)
            for own in np.unique(d):
                at = np.flatnonzero(d == own)
                projection, tree = tops.value[int(own)]
                cell[at] = tree.leaf(projection.of(np.array([v[i] for i in at])))
            yield pa.RecordBatch.from_arrays([b["d"], pa.array(cell), b["v"], b["ids"]], ["d", "cell", "v", "ids"])

    placed = entries.mapInArrow(celled, "d int, cell int, v array<double>, ids array<bigint>")
    # a row for each cell of thousands of vectors; a part goes by the vector's hash
    many = placed.groupBy("d", "cell").agg(F.count("*").alias("n")).where(F.col("n") > 2 * CELL).select("d", "cell", F.ceil(F.col("n") / CELL).alias("parts"))
    rows = placed.join(F.broadcast(many), ["d", "cell"], "left").select("d", "cell", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "v", "ids")

    def build(key, pdf):
        pdf = pdf.assign(o=[x[0] for x in pdf["ids"]]).sort_values("o", kind="stable")
        index = CellIndex(np.stack(pdf["v"].to_numpy()), [np.asarray(x, np.int64) for x in pdf["ids"]], tops.value[int(key[0])][0])
        return pd.DataFrame({"d": [key[0]], "cell": [key[1]], "part": [key[2]], "low": [index.low], "high": [index.high], "data": [pickle.dumps(index)]})

    shape = "d int, cell int, part int, low array<double>, high array<double>, data binary"
    return written(rows.groupBy("d", "cell", "part").applyInPandas(build, shape), "cells")


SENT = "block long, q long, query_id long, v array<double>, d int, least double"


def _next_cells(tops, boxes, done: int, width: int, confidence: float):
    """For each query the next `width` cells by projected distance, those that the test does not rule out."""

    def run(batches):
        for b in batches:
            rows = []
            for q, own, v, d, least in zip(*(b[c].to_pylist() for c in ("q", "query_id", "v", "d", "least")), strict=True):
                projection = tops.value[d][0]
                blocks, low, high = boxes.value[d]
                query = np.array(v)
                p = projection.of_query(query)
                gap = np.maximum(0, np.maximum(low - p, p - high))
                far = (gap * gap).sum(axis=1)
                for i in np.lexsort((blocks, far))[done : done + width]:
                    if least is not None and chi_square_cdf(far[i] / projection.distance(least, query), projection.dims) >= confidence:
                        break
                    rows.append((int(blocks[i]), q, own, v, d, least))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["block", "q", "query_id", "v", "d", "least"])

    return run


def _asked(sent: DataFrame, index: DataFrame, tops, k: int, confidence: float) -> DataFrame:
    """(q, vec_id, score): each cell's best for the queries sent to it."""

    def find(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})]
        if len(mine) and len(theirs):
            cell = pickle.loads(theirs["data"].iloc[0])
            for q, own, v, d, least in mine[["q", "query_id", "v", "d", "least"]].itertuples(index=False):
                ids, scores = cell.search(own, np.asarray(v, float), tops.value[d][0], k, confidence, -math.inf if pd.isna(least) else least)
                out.append(pd.DataFrame({"q": np.full(len(ids), q), "vec_id": ids, "score": scores}))
        return pd.concat(out)

    # a row for each cell
    parts = sent.groupBy("block").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    dealt = sent.join(F.broadcast(parts), "block").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int"))
    copies = index.select("block", "data").join(F.broadcast(parts), "block").select("block", "data", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return dealt.groupBy("block", "part").cogroup(copies.groupBy("block", "part")).applyInPandas(find, "q long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query, k: int = K, confidence: float = CONFIDENCE, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the vectors whose vec_id meets is_query(column)."""
    spark = vectors.sparkSession
    rows = usable(vectors, vector)
    entries = written(_entries(rows, k), "vectors")
    tops = spark.sparkContext.broadcast(_tops(entries))
    index = build_index(entries, tops).withColumn("block", F.xxhash64("d", "cell", "part"))
    found: dict[int, list] = {}
    for r in index.select("d", "block", "low", "high").collect():  # 136 bytes a cell
        found.setdefault(r["d"], []).append((r["block"], r["low"], r["high"]))
    held = {d: tuple(np.array(x) for x in zip(*own, strict=True)) for d, own in found.items()}
    boxes = spark.sparkContext.broadcast(held)
    asked = rows.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "v", "d").distinct()
    queries = written(asked.withColumn("q", F.monotonically_increasing_id()), "queries")
    best = written(spark.createDataFrame([], "q long, vec_id long, score double, rank int"), "best")
    done, width, most = 0, 1, max((len(x[0]) for x in held.values()), default=0)
    while done < most:
        least = best.where(F.col("rank") == k).select("q", F.col("score").alias("least"))
        sent = written(queries.join(least, "q", "left").mapInArrow(_next_cells(tops, boxes, done, width, confidence), SENT), "asked")
        new = _asked(sent, index, tops, k, confidence).unionByName(best.select("q", "vec_id", "score"))
        ranked = new.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id")))
        best = written(ranked.where(F.col("rank") <= k), "best")
        done, width = done + width, width * FAN
    return best.join(queries.select("q", "query_id"), "q").select("query_id", "rank", "vec_id", "score")
