r"""Source divergence audit: how unlike the sources of a language use its words, on run-length columns.

Terms are runs of letters (A-Z lower-cased; all characters from U+0080 count as letters). Tasks add up
(language, source, term) counts before the shuffle. A language keeps the V terms that at least `least_docs`
of its rows hold; a source gives each kept term the share p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)),
and two shares differ by f = floor((p - q)**2 / (p + q)).

The vocabulary is cut into blocks of terms of like frequency, and sources into tiles, so a task holds
a bounded block of counts. There the vocabulary is reordered, by count columns from few to many distinct
counts, so that equal counts come together; each source's column is run-length encoded; for a pair the
boundaries of both are merged, and f is taken once for each stretch between boundaries and multiplied by
its length. Block sums are added up by Spark. All pairs of sources of a language are the result that is
asked for; terms are never paired.

A null text, language or source is an empty string. A source without kept terms has uniform shares, and a
language without any gives pairs of value 0. Ties of values go by UTF-8 order. Rows count as documents one by
one, also repeated ones. Very long texts are read whole. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import written

LEAST_DOCS, TOP = 10, 10
#: Terms of a block (a block takes up to about three times as many) and sources of half a tile.
BLOCK_TERMS, TILE = 4096, 64
#: Counts that a task holds before it hands them on.
HELD = 400_000
#: Bytes that stand in no term become spaces, A-Z lower case.
_LETTERS = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

_COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms and of the rows that hold them, and for each group a row of the empty term."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out():
        for (lang, source), (n, docs) in held.items():
            terms = pa.array([b"", *n], pa.binary()).cast(pa.string())
            columns = [pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source")), batch["text"], strict=True):
            words = text.as_py().encode().translate(_LETTERS).split()
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            n.update(words)
            docs.update(set(words))
            size += len(n)
            if size > HELD:
                yield from out()
                size = 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), with an empty term of zeros for each group."""
    rows = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return rows.mapInArrow(_counted, _COUNTS).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / total), by long division; exact for totals below 9 * 10**15."""
    out, rest = np.divmod(count + 2, max(1, total))
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, max(1, total))
        out = out * 1000 + digits
    return out + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def reordered(counts: np.ndarray) -> np.ndarray:
    """An order of the columns of counts (sources x terms) that brings equal counts together: by the rows, those of fewest distinct counts first."""
    kinds = [len(np.unique(row)) for row in counts]
    return np.lexsort([counts[k] for k in sorted(range(len(counts)), key=lambda k: (-kinds[k], -k))]) if len(counts) else np.arange(counts.shape[1])


def run_lengths(row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values) of the runs of row, which zeros fill up to length."""
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    values = row[starts]
    if length > len(row) and not (len(row) and row[-1] == 0):
        starts, values = np.append(starts, len(row)), np.append(values, 0)
    return starts, values


def summed(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], length: int) -> int:
    """The differences of two columns of shares, given as runs, summed over all terms."""
    bounds = np.union1d(a[0], b[0])
    p, q = (x[1][np.searchsorted(x[0], bounds, "right") - 1] for x in (a, b))
    return int((difference(p, q) * np.diff(np.append(bounds, length))).sum())


_FOUND = "lang string, source string, part string, item string, value long"


def _audited(top: int):
    def block(key, frame: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        lang, _, low, high = key
        frame = frame.sort_values("source", ignore_index=True)
        if not len(frame):
            return pd.DataFrame({c: [] for c in ("lang", "source", "part", "item", "value")})
        sources, chunk, v, length = frame["source"].tolist(), frame["chunk"].to_numpy(), int(frame["v"][0]), int(frame["terms"][0])
        place = {s: k for k, s in enumerate(sources)}
        term, names = pd.factorize(cells["term"])
        counts = np.zeros((len(sources), len(names)), np.int64)
        counts[cells["source"].map(place).to_numpy(np.int64), term] = cells["n"].to_numpy(np.int64)
        order = reordered(counts)
        runs = []
        for k, n in enumerate(frame["n"]):
            starts, values = run_lengths(counts[k][order], length)
            runs.append((starts, shares(values, int(n) + 2 * v)))
        found = []
        for a in range(len(sources)):
            for b in range(a + 1, len(sources)):
                if (min(chunk[a], chunk[b]), max(chunk[a], chunk[b])) == (low, high):  # else another tile has this pair
                    value = summed(runs[a], runs[b], length)
                    found += [(lang, sources[a], "pair", sources[b], value), (lang, sources[b], "pair", sources[a], value)]
        if low == high and len(names):
            total = np.zeros(len(names), np.int64)
            total[term] = cells["total"].to_numpy(np.int64)
            q = shares(total, int(frame["lang_n"][0]) + 2 * v)
            for k, n in enumerate(frame["n"]):
                p = shares(counts[k], int(n) + 2 * v)
                at = np.flatnonzero((counts[k] > 0) & (p > q))
                f = difference(p[at], q[at])
                if len(at) > top:
                    stay = f >= np.partition(f, -top)[-top]
                    at, f = at[stay], f[stay]
                best = sorted(zip((-f).tolist(), (names[i] for i in at), strict=True))[:top]
                found += [(lang, sources[k], "term", t, -x) for x, t in best]
        return pd.DataFrame(found, columns=["lang", "source", "part", "item", "value"])

    return block


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block_terms: int = BLOCK_TERMS, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group of docs (lang, source, text) all other sources of its language by their
    difference (part pair), and the `top` terms that it overuses most against its language (part term)."""
    by_term = Window.partitionBy("lang", "term")
    kept = term_counts(docs).withColumns({"total": F.sum("n").over(by_term), "held": F.sum("docs").over(by_term), "least": F.min("source").over(by_term)})
    kept = kept.where((F.col("held") >= least_docs) | (F.col("term") == ""))
    band = F.when(F.col("term") == "", -1).otherwise(F.floor(F.log2(F.col("total").cast("double")) * 8)).cast("int")
    counted = ((F.col("term") != "") & (F.col("source") == F.col("least"))).cast("long")
    kept = written(kept.select("lang", "source", "term", "n", "total", band.alias("band"), counted.alias("counted")), "term-counts")

    # blocks: bands of like frequency one after the other, large ones cut by a hash of the term
    bands = kept.groupBy("lang", "band").agg(F.sum("counted").alias("terms"))
    before = F.coalesce(F.sum("terms").over(Window.partitionBy("lang").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = bands.select("lang", "band", F.floor(before / block_terms).alias("block"), F.greatest(F.lit(1), F.ceil(F.col("terms") / block_terms)).alias("parts"))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = Window.partitionBy("lang")
    number = F.row_number().over(of_lang.orderBy("source")) - 1
    groups = groups.withColumns({"chunk": F.floor(number / tile).cast("int"), "lang_n": F.sum("n").over(of_lang)})
    groups = written(groups.withColumn("chunks", F.max("chunk").over(of_lang) + 1), "term-groups")

    placed = kept.join(bands, ["lang", "band"]).withColumn("block", F.col("block") + F.pmod(F.xxhash64("term"), F.col("parts"))).drop("band", "parts")
    placed = written(placed, "term-blocks")
    blocks = placed.groupBy("lang", "block").agg(F.sum("counted").alias("terms"))
    blocks = blocks.withColumn("v", F.sum("terms").over(of_lang))
    tiles = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, F.col("chunk")).alias("low"), F.greatest(k, F.col("chunk")).alias("high"))))
    frame = groups.join(blocks, "lang").withColumn("tile", tiles).select("lang", "block", "tile.low", "tile.high", "source", "chunk", "n", "lang_n", "v", "terms")
    frame = written(frame, "term-frame")
    cells = placed.where("term != ''").join(groups.select("lang", "source", "chunk", "chunks"), ["lang", "source"]).withColumn("tile", tiles)
    cells = cells.select("lang", "block", "tile.low", "tile.high", "source", "term", "n", "total")
    key = ("lang", "block", "low", "high")
    found = frame.groupBy(*key).cogroup(cells.groupBy(*key)).applyInPandas(_audited(top), _FOUND)

    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term is in one block, a pair in all
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
