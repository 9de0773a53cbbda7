r"""Periodic runs: stretches of words that repeat with a period, and texts without the repeats.

A run is a stretch of words with smallest period q and at least max(12, 2 * q) words that can't be
extended on either side. For each q a grid of places max(q, 12 - q) apart meets every run of that
period, so the places of all grids together (about n * ln n) are the candidates; those that equal the
word q further on are extended both ways on a recompression grammar (`recompression.py`), exactly.
Documents are worked on in groups of some 300,000 words; a longer document is a group by itself, and
its grids are gone through in slices. Nothing is shuffled.

Null, empty and white texts have no words: no runs and an empty text. Tied and repeated rows get equal
results. Very long texts are taken whole. An empty table gives no rows. Extra columns, also of clashing
names, travel in the struct `row`.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import WORD, let
from palisade.llm.recompression import Grammar

LEAST_WORDS = 12
#: Words of documents that share one grammar.
GROUP_WORDS = 300_000
#: Documents of up to so many words share one table of grid places; those of longer ones are made in slices.
TABLE_WORDS, SLICE = 1 << 15, 1 << 20


def _grid(words: int, periods: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, place + period) for every grid place of these periods."""
    step = np.maximum(periods, least - periods)
    n = np.maximum(0, -(-(words - periods) // step))
    q = np.repeat(periods, n)
    i = (np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)) * np.repeat(step, n)
    return i, i + q


@functools.cache
def _table(least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid places in order of the place compared with, and how many of them lie in the first n words."""
    i, j = _grid(TABLE_WORDS, np.arange(1, TABLE_WORDS // 2 + 1), least)
    order = np.argsort(j, kind="stable")
    i, j = i[order].astype(np.int32), j[order].astype(np.int32)
    return i, j, np.searchsorted(j, np.arange(TABLE_WORDS + 1))


def _candidates(w: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid places of one document whose words are equal."""
    n = len(w)
    if n <= TABLE_WORDS:
        i, j, upto = _table(least)
        i, j = i[: upto[n]], j[: upto[n]]
        hit = w[i] == w[j]
        return i[hit].astype(np.int64), j[hit].astype(np.int64)
    found, q = [], 1
    while q <= n // 2:
        many = max(1, SLICE * max(q, least - q) // n)
        i, j = _grid(n, np.arange(q, min(q + many, n // 2 + 1)), least)
        hit = w[i] == w[j]
        found.append((i[hit], j[hit]))
        q += many
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs_of(docs: list[np.ndarray], least: int = LEAST_WORDS) -> list[np.ndarray]:
    """For each sequence of word numbers its runs (start, length, period), by start and period."""
    edge = max((int(w.max()) for w in docs if len(w)), default=0) + 1
    parts, offsets, at, places, others, owner = [], [], 1, [], [], []
    for k, w in enumerate(docs):
        parts += [np.array([edge + k], np.int64), w]  # a symbol of its own before each document
        offsets.append(at)
        if len(w) >= least:
            i, j = _candidates(w, least)
            places.append(i + at)
            others.append(j + at)
            owner.append(np.full(len(i), k))
        at += len(w) + 1
    none = np.zeros((0, 3), np.int64)
    if not places:
        return [none] * len(docs)
    i, j, doc = np.concatenate(places), np.concatenate(others), np.concatenate(owner)
    grammar = Grammar(np.concatenate([*parts, np.array([edge + len(docs)], np.int64)]))
    ahead, behind, q = grammar.forward(i, j), grammar.backward(i - 1, j - 1), j - i
    hit = ahead + behind >= np.maximum(q, least - q)
    start, end, q, doc = (i - behind)[hit], (j + ahead)[hit], q[hit], doc[hit]
    # a run is also met at multiples of its period: of one stretch the least period stays
    order = np.lexsort((q, end, start))
    start, end, q, doc = start[order], end[order], q[order], doc[order]
    first = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.zeros(0, bool)
    start, end, q, doc = start[first], end[first], q[first], doc[first]
    rows = np.stack([start - np.array(offsets, np.int64)[doc], end - start, q], axis=1)
    rows = rows[np.lexsort((q, start))]
    doc = doc[np.lexsort((q, start))]
    cut = np.searchsorted(doc, np.arange(len(docs) + 1))
    return [rows[cut[k] : cut[k + 1]] for k in range(len(docs))]


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words that no run covers after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words).decode()
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)).decode()


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Slices of the rows with about GROUP_WORDS words each: the first row and the words of each."""
    first, group, n = 0, [], 0
    for k in range(len(texts)):
        words = (texts[k].as_py() or "").encode().split()  # splits at \x20 and \x09-\x0D
        if group and n + len(words) > GROUP_WORDS:
            yield first, group
            first, group, n = k, [], 0
        group.append(words)
        n += len(words)
    if group:
        yield first, group


def _work(least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, group in _groups(batch["text"]):
                number = _Numbers()
                found = runs_of([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in group], least)
                flat = np.concatenate(found)
                ends = pa.array(np.append(0, np.cumsum([len(r) for r in found])), pa.int32())
                runs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(_RUN)))
                collapsed = pa.array([_collapsed(w, r) for w, r in zip(group, found, strict=True)], pa.string())
                n = pa.array([len(w) for w in group], pa.int64())
                yield pa.RecordBatch.from_arrays([batch["row"].slice(first, len(group)), n, runs, collapsed], ["row", "n_words", "runs", "collapsed"])

    return work


def periodic_runs(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(row, n_words, runs, collapsed) of each document: row holds the other columns, runs is an array of
    (start, length, period) by start and period, collapsed the text without repeats, its words joined by one space."""
    if least_words < 2:
        raise ValueError("least_words must be 2 or more")
    rest = [docs[c] for c in docs.columns if c != text] or [F.lit(True).alias("none")]
    base = docs.select(F.struct(*rest).alias("row"), docs[text].cast("string").alias("text"))
    runs = T._parse_datatype_string("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").fields
    return base.mapInArrow(_work(least_words), T.StructType([base.schema["row"], *runs]))


def longest(runs: Column) -> Column:
    """The run of greatest length; of ties the one of smallest start, then period. Null without runs."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] > best["length"], r).otherwise(best))


def listed(runs: Column) -> Column:
    """Each run as `start,length,period` and a line feed."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where in a document in ten, told by h = crc32(doc_id), every word from a on is word a + (i - a) % p:
    a = g % n, p = 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10), n words. Documents with a null doc_id stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        return let(g % n, lambda a: let(F.lit(1) + F.floor((n - a) / (3 + g % 8)).cast("long"), lambda p: F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")))

    text = F.col("text").cast("string")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return docs.select("doc_id", F.when((h % 10 == 0) & text.rlike(WORD), let(words, repeated)).otherwise(text).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """A row for each of docs (doc_id, text): the number of runs, the longest, and digests of all and of the collapsed text."""
    out = periodic_runs(with_planted_repeats(docs)).withColumn("best", longest(F.col("runs")))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
