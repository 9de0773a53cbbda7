r"""SimHash near-dedup by covering locality-sensitive hashing.

A text's 64-bit fingerprint holds the majority bits of its shingles' XXH64 values. For radius r each
bit position gets a vector of r + 1 random bits; the mask of a non-zero vector v drops the positions
whose vector is orthogonal to v. Any r positions leave some v orthogonal to all of their vectors, so
two fingerprints at most r bits apart agree under one of the 2^(r+1) - 1 masks: no pair is missed.

Only distinct fingerprints are tabled. The rows of a table come sorted by masked value to a task,
which links each run by a spanning forest (never all pairs): short runs by direct comparison, long
ones by looking up every fingerprint within the radius, so a run costs no more than its length
times a constant. The links are merged by distributed connected components.

Null and empty texts have fingerprint zero and are linked like any other. Texts with fewer words than
a shingle give one shingle of all of them. Very long texts are read whole. A bit set in just half of the hashes is 0.
Repeated rows share a fingerprint; a null doc_id is
ignored when a component's smallest doc_id is taken. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import join_uneven, written
from palisade.llm.components import components

RADIUS, SHINGLE = 3, 3
#: Runs over this length look up neighbours instead of comparing.
LONG_RUN = 4096
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def masks(radius: int = RADIUS, seed: int = 7) -> list[int]:
    rng = random.Random(seed)
    vectors = [rng.randrange(1 << (radius + 1)) for _ in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, 1 << (radius + 1))]


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    w = (text or "").encode().translate(_LOWER).split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return digest(b" ".join(w), 42)
    h = np.fromiter((digest(b" ".join(x), 42) for x in zip(*(w[i:] for i in range(words)), strict=False)), np.uint64, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE, mark=None) -> DataFrame:
    """(doc_id, fp[, mark]): the fingerprint as a signed 64-bit number; mark is a column of 64-bit numbers."""
    more = [] if mark is None else ["mark"]

    def of(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fps.view(np.int64)), *(b[m] for m in more)], ["doc_id", "fp", *more])

    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([] if mark is None else [mark.alias("mark")])]
    return docs.select(*own).mapInArrow(of, ", ".join(f"{c} long" for c in ("doc_id", "fp", *more)))


def _flips(radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(1, radius + 1) for c in itertools.combinations(range(64), r)], np.uint64)


def link_run(fps: np.ndarray, radius: int, mask: int) -> list[tuple[np.uint64, np.uint64]]:
    """A spanning forest of the links among distinct fingerprints that agree under mask."""
    if len(fps) == 2:
        return [(fps[0], fps[1])] if np.bitwise_count(fps[0] ^ fps[1]) <= radius else []
    fps = np.sort(fps)
    free, edges = np.ones(len(fps), bool), []
    flips = None
    if len(fps) > LONG_RUN:
        flips = _flips(radius)
        flips = flips[(flips & np.uint64(mask)) == 0]
    for seed in range(len(fps)):
        if not free[seed]:
            continue
        free[seed], stack = False, [seed]
        while stack:
            i = stack.pop()
            if flips is None:
                near = np.flatnonzero(free)
                near = near[np.bitwise_count(fps[near] ^ fps[i]) <= radius]
            else:
                want = fps[i] ^ flips
                near = np.minimum(np.searchsorted(fps, want), len(fps) - 1)
                near = near[(fps[near] == want) & free[near]]
            free[near] = False
            stack += near.tolist()
            edges += [(fps[i], fps[j]) for j in near]
    return edges


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): enough links at most radius bits apart to join everything that such links join."""
    all_masks = masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in all_masks]
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)])
    rows = distinct.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")

    def runs(batches):
        t, key, fp = (np.empty(0, np.int64) for _ in range(3))
        for b in itertools.chain(batches, [None]):
            if b is not None:
                t, key, fp = (np.concatenate([x, b[c].to_numpy()]) for x, c in ((t, "t"), (key, "key"), (fp, "fp")))
                if not len(t):
                    continue
            if not len(t):
                return
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate([[0], cut])
            ends = np.concatenate([cut, [len(t)]])
            if b is not None:  # the last run may go on in the next batch
                starts, ends = starts[:-1], ends[:-1]
            edges = []
            for i in np.flatnonzero(ends - starts > 1):
                edges += link_run(fp[starts[i] : ends[i]].view(np.uint64), radius, all_masks[t[starts[i]]])
            done = ends[-1] if len(ends) else 0
            t, key, fp = t[done:], key[done:], fp[done:]
            if edges:
                e = np.array(edges, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])
            if b is None:
                return

    # the hash of both columns deals runs out; a run meets in one task, as 64-bit numbers only
    return rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(runs, "a long, b long")


def _roots(fps: DataFrame, first, radius: int) -> DataFrame:
    """(fp, first, n, root) of each distinct fingerprint: the aggregate first of its rows, their number, and its component."""
    distinct = fps.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n"))
    comp = components(links(distinct.select("fp"), radius))
    roots = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    return written(roots, "roots")


def text_mark():
    return F.xxhash64(F.col("text").cast("string"))


def representatives(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, mark, n): of each component the smallest doc_id (null last) with its smallest text mark, and the rows that have both."""
    fps = written(fingerprints(docs, words, text_mark()), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    kept = _roots(fps, least, radius).groupBy("root").agg(F.min("first").alias("f")).select(F.col("f.doc_id").alias("id"), F.col("f.mark").alias("of"))
    kept = kept.distinct()
    rows = fps.join(kept, fps["doc_id"].eqNullSafe(kept["id"]) & (fps["mark"] == kept["of"]))
    return written(rows.groupBy("doc_id", "mark").agg(F.count("*").alias("n")), "representatives")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of at most radius bits."""
    fps = written(fingerprints(docs, words), "fingerprints")
    roots = _roots(fps, F.min("doc_id"), radius)
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id", "n")
    return join_uneven(fps, named, "fp", fps.count()).select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
