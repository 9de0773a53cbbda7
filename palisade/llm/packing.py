r"""Best-fit packing of tokenised documents into sequences of fixed length, by bulk-synchronous supersteps.

Documents longer than a sequence are cut into full pieces and a rest. Pieces of one length form a run
(length, how many are left, the rank of the next); open sequences with one gap form a run too. Sizes
are whole numbers up to the capacity, so the tables of runs stay small whatever the corpus. A superstep is a
Spark job over both tables:

1. Runs are range-sorted by size, larger first, gaps before pieces of their size.
2. Each task sweeps its range: a run of pieces takes the run of gaps seen last, which is its
   successor, the tightest gap that holds it. Contention is resolved by rank: larger lengths come first
   and a length's ranks are handed out in order. A gap takes as many equal pieces as it holds.
3. Ranges meet in pairs, then pairs of pairs, as brackets are matched in parallel: the gaps that the larger half has left over
   meet the pieces that the smaller half could not place, and nothing else moves. So no task sees all runs.
4. Pieces that found no gap at all and are longer than 1 / BAND of the longest one open sequences: whole sequences of one length
   each range by itself, then what is left of the lengths, under one sequence each, larger first, in one task. That rest is at most
   a row for each of the capacity's lengths, whatever the corpus.
5. Gaps are updated; runs and matches are written; the next superstep reads them.

After a superstep no piece longer than 1 / BAND of the longest is left, so there are at most
log(capacity) / log(BAND) supersteps. Matches are ranges of ranks. Pieces get their ranks from a distributed
count over (length, salt), with more salts for a length of many pieces, and find their place in the ranges: in a broadcast table of
at most MOST_MATCHES ranges (counted first), beyond that by blocks of ranks, in which pieces and ranges are sorted together.

Null and empty texts are one end token. Very long texts give many pieces, each a row. Pieces of equal length are ranked by
(salt, doc_id, piece, checksum); repeated rows are packed each on its own. A null doc_id is kept. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.llm.common import written

CAPACITY, END_ID = 4096, 1
#: Entries of the word cache of a Python worker; longer words are not kept.
CACHE_WORDS, CACHE_BYTES = 1 << 19, 48
TEXTS_AT_ONCE, WORDS_AT_ONCE = 256, 256
#: In a superstep pieces longer than 1 / BAND of the longest are all placed.
BAND = 2.0
#: Ranges that a superstep's runs are dealt to, 2 ** LEVELS.
LEVELS = 2
RANGES = 1 << LEVELS
#: Pieces of a length and salt that are ranked together, at least and at most.
RANKED = (256, 20_000)
#: Matches that may be broadcast, of 40 bytes each; beyond it, ranks that are placed together.
MOST_MATCHES, PLACED = 500_000, 10_000


def _gaps(found: list) -> list[int]:
    """Where found holds None."""
    out = []
    try:
        i = found.index(None)
        while True:
            out.append(i)
            i = found.index(None, i + 1)
    except ValueError:
        return out


class WordTokenizer:
    """ids of whole texts, by words: the tokenizer splits at white space, so each distinct word is encoded once and kept.

    The table of words stops growing when full; frequent words come early, so it holds them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.known = Tokenizer.from_file(path), {}

    def _encode(self, words: list[bytes]):
        """(word, ids) of distinct words, WORDS_AT_ONCE in one string, split again by the places of the ids."""
        for i in range(0, len(words), WORDS_AT_ONCE):
            part = words[i : i + WORDS_AT_ONCE]
            texts = [w.decode() for w in part]
            got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids = np.array(got.ids, "<u4").tobytes()
            at = np.array([o[0] for o in got.offsets], np.int64)
            size = np.array([len(t) + 1 for t in texts], np.int64)
            first = (4 * np.searchsorted(at, np.cumsum(size) - size)).tolist() + [len(ids)]
            for w, a, b in zip(part, first, first[1:], strict=False):
                yield w, ids[a:b]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text."""
        known, split, found, new = self.known, [], [], set()
        for t in texts:
            words = t.split()
            got = list(map(known.get, words))
            new.update(words[i] for i in _gaps(got))
            split.append(words)
            found.append(got)
        own = dict(self._encode(list(new)))
        if len(known) < CACHE_WORDS:
            known.update((w, x) for w, x in own.items() if len(w) <= CACHE_BYTES)
        out = []
        for words, got in zip(split, found, strict=True):
            for i in _gaps(got):
                got[i] = own[words[i]]
            out.append(b"".join(got))
        return out


@functools.cache
def _tokenizer(path: str) -> WordTokenizer:
    """A worker's tokenizer with its word table, kept from task to task."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document with its end token."""

    def cut(batches):
        words = _tokenizer(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            docs, texts = b["doc_id"].to_pylist(), [t or b"" for t in b["text"].cast(pa.binary()).to_pylist()]
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                for doc, own in zip(docs[at : at + TEXTS_AT_ONCE], words.ids(texts[at : at + TEXTS_AT_ONCE]), strict=True):
                    ids = own + end
                    for i in range(0, len(ids), 4 * capacity):
                        part = ids[i : i + 4 * capacity]
                        rows.append((doc, i // (4 * capacity), i // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


SHAPE = "kind int, size int, n long, at long, left long, offset int"
#: Rows of SHAPE. PIECES: n of length `size` from rank `at`. GAPS: n sequences from `at` on with `size` free.
#: MATCH: n sequences from `at` on take pieces of length `size` from rank `left` on at `offset`, a piece each.
GAPS, PIECES, MATCH = 0, 1, 2


def _rows(kind: int, runs) -> list[tuple]:
    return [(kind, *r) for r in runs]


def sweep(runs: list[tuple[int, int, int, int]], capacity: int = CAPACITY):
    """(matches, pieces left, gaps left, new gaps) of runs (kind, size, n, at), larger first, gaps before pieces.

    The stack holds the gaps passed so far; its top is the successor of the next run of pieces."""
    stack: list[list[int]] = []
    matches, pieces, fresh = [], [], []
    for kind, size, n, at in runs:
        if kind == GAPS:
            stack.append([size, n, at])
            continue
        rank = at
        while n and stack:
            gap, free, first = stack[-1]
            each = min(gap // size, n)
            used = min(free, n // each)
            matches += [(size, used, first, rank + c * used, capacity - gap + c * size) for c in range(each)]
            if gap > each * size:
                fresh.append((gap - each * size, used, first))
            rank, n = rank + each * used, n - each * used
            if used == free:
                stack.pop()
            else:
                stack[-1][1:] = free - used, first + used
        if n:
            pieces.append((size, n, rank))
    return matches, pieces, [tuple(g) for g in stack], fresh


def opened(pieces, longest: int, step: int, capacity: int = CAPACITY, band: float = BAND):
    """(matches, pieces left, gaps) after the pieces longer than longest / band opened sequences.

    A run fills as many sequences as it can; what is left of it shares one with the next runs, if those fit."""
    matches, left, gaps = [], [], []
    gap = shared = 0
    for size, n, rank in pieces:
        if size * band <= longest:
            left.append((size, n, rank))
            continue
        first = step << 57 | size << 40 | 1 << 39  # a length opens shared sequences once a superstep
        while n:
            if gap >= size:
                each, used, base, at = min(gap // size, n), 1, capacity - gap, shared
                gap -= each * size
            else:
                each, base, at = min(capacity // size, n), 0, first
                used = n // each
                room = capacity - each * size
                if each == capacity // size:
                    gaps += [(room, used, first)] if room else []
                else:  # the last of the run
                    gaps += [(gap, 1, shared)] if gap else []
                    gap, shared = room, first
                first += used
            matches += [(size, used, at, rank + c * used, base + c * size) for c in range(each)]
            rank, n = rank + each * used, n - each * used
    return matches, left, [*gaps, (gap, 1, shared)] if gap else gaps


def filled(pieces, longest: int, step: int, capacity: int = CAPACITY, band: float = BAND):
    """(matches, pieces left, gaps) after the pieces longer than longest / band filled whole sequences with their own length."""
    matches, left, gaps = [], [], []
    for size, n, rank in pieces:
        each, first = capacity // size, step << 57 | size << 40
        used = n // each if size * band > longest else 0
        if used:
            matches += [(size, used, first, rank + c * used, c * size) for c in range(each)]
            gaps += [(capacity - each * size, used, first)] if each * size < capacity else []
        if n > used * each:
            left.append((size, n - used * each, rank + used * each))
    return matches, left, gaps


def _batch(rows):
    cols = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["kind", "size", "n", "at", "left", "offset"])


#: SHAPE with the range of a run. Gaps with left = 1 are new: they wait for the next superstep.
RANGED = SHAPE + ", part int"
_FIELDS = ("kind", "size", "n", "at", "left", "offset", "part")


def _ranged(rows: list[tuple]) -> pa.Table:
    plain, parts = _batch([r[:6] for r in rows]), pa.array([r[6] for r in rows], pa.int32())
    return pa.Table.from_batches([plain]).append_column("part", parts)


def _left(part: int, matches, pieces, gaps, fresh) -> list[tuple]:
    """What a sweep leaves, as rows of RANGED."""
    held = [(PIECES, *p, None, None) for p in pieces] + [(GAPS, *g, 0, None) for g in gaps] + [(GAPS, *g, 1, None) for g in fresh]
    return [(*r, part) for r in [*held, *_rows(MATCH, matches)]]


def _new(rows: list[tuple], opening, step: int, longest: int, capacity: int, band: float) -> list[tuple]:
    """rows after each range's pieces took new sequences by `opening`: filled or opened."""
    out = [r for r in rows if r[0] != PIECES]
    for part in {r[6] for r in rows if r[0] == PIECES}:
        own = sorted((r[1:4] for r in rows if r[0] == PIECES and r[6] == part), key=lambda p: -p[0])
        matches, pieces, gaps = opening(own, longest, step, capacity, band)
        out += _left(part, matches, pieces, gaps, [])
    return out


def superstep(runs: DataFrame, step: int, longest: int, capacity: int = CAPACITY, band: float = BAND) -> DataFrame:
    """The runs left and the matches of one superstep over runs (GAPS and PIECES)."""

    def within(batches):
        from pyspark import TaskContext

        own = [r for b in batches for r in zip(*(b[c].to_pylist() for c in _FIELDS[:4]), strict=True)]
        # ranges are numbered from the largest sizes on
        yield from _ranged(_left(TaskContext.get().partitionId(), *sweep(own, capacity))).to_batches()

    def meeting(level: int):
        def meet(key, table):
            rows = list(zip(*(table[c].to_pylist() for c in _FIELDS), strict=True))
            if key[0].as_py() >= 0:
                by_size = sorted(rows, key=lambda r: (-r[1], r[0], r[3]))
                parts = {GAPS: {r[3]: r[6] for r in rows if r[0] == GAPS}, PIECES: {r[1]: r[6] for r in rows if r[0] == PIECES}}
                matches, pieces, gaps, fresh = sweep([r[:4] for r in by_size], capacity)
                low = max(parts[PIECES].values(), default=rows[0][6])
                rows = _left(low, matches, [], [], fresh)
                for p in pieces:
                    rows += _left(parts[PIECES][p[0]], [], [p], [], [])
                rows += _left(min(parts[GAPS].values(), default=low), [], [], gaps, [])
            return _ranged(_new(rows, filled, step, longest, capacity, band) if level == LEVELS - 1 else rows)

        return meet

    def rest(key, table):
        rows = list(zip(*(table[c].to_pylist() for c in _FIELDS), strict=True))
        return _ranged(rows if key[0].as_py() < 0 else _new([(*r[:6], 0) for r in rows], opened, step, longest, capacity, band))

    order = (F.desc("size"), "kind", "at")
    now = runs.repartitionByRange(RANGES, *order).sortWithinPartitions(*order).mapInArrow(within, RANGED)
    for level in range(LEVELS):
        smaller = F.shiftright("part", level).bitwiseAND(F.lit(1)) == 1
        waits = (F.col("kind") == PIECES) & smaller | (F.col("kind") == GAPS) & (F.col("left") == 0) & ~smaller
        team = F.when(waits, F.shiftright("part", level + 1)).otherwise(-1 - F.col("part"))
        now = now.withColumn("team", team).groupBy("team").applyInArrow(meeting(level), RANGED)
    over = (F.col("kind") == PIECES) & (F.col("size") * F.lit(band) > longest)
    return now.withColumn("team", F.when(over, 0).otherwise(-1 - F.col("part"))).groupBy("team").applyInArrow(rest, RANGED).drop("part")


def supersteps(counts: DataFrame, capacity: int = CAPACITY, band: float = BAND) -> DataFrame:
    """MATCH rows for counts (length, n): every piece of a length is in one match."""
    runs = counts.select(F.lit(PIECES).alias("kind"), F.col("length").cast("int").alias("size"), "n", F.lit(0).cast("long").alias("at"))
    runs = written(runs.withColumns({"left": F.lit(None).cast("long"), "offset": F.lit(None).cast("int")}), "runs-0")
    found, step = None, 0
    while (longest := runs.where(F.col("kind") == PIECES).agg(F.max("size")).first()[0]) is not None:
        step += 1
        out = written(superstep(runs, step, longest, capacity, band), f"runs-{step}")
        matches, runs = out.where(F.col("kind") == MATCH), out.where(F.col("kind") != MATCH)
        found = matches if found is None else found.unionByName(matches)
    return runs.where(F.col("kind") == MATCH) if found is None else found


def pack(parts: DataFrame, capacity: int = CAPACITY, most_matches: int = MOST_MATCHES) -> DataFrame:
    """parts (with a column length up to capacity) and sequence_id, offset."""
    spark = parts.sparkSession
    parts = written(parts, "pieces")
    counts = written(parts.groupBy("length").agg(F.count("*").alias("n")), "lengths")
    matches = supersteps(counts, capacity).select("size", F.col("left").alias("rank"), "n", F.col("at").alias("first"), "offset")
    total = counts.agg(F.sum("n")).first()[0] or 0
    ranked = min(max(total // 1000, RANKED[0]), RANKED[1])
    # lengths of many pieces: at most `capacity` rows
    many = counts.where(F.col("n") > ranked).select("length", F.ceil(F.col("n") / ranked).alias("__salts"))
    salted = parts.join(F.broadcast(many), "length", "left").withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.coalesce("__salts", F.lit(1)))).drop("__salts")
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("length").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "__salt", before.alias("__before"))
    own = F.row_number().over(W.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    placed = salted.withColumn("__rank", own).join(sizes, ["length", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    return _looked_up(placed, matches, parts) if matches.count() <= most_matches else _merged(placed, matches, parts)


def _looked_up(placed: DataFrame, matches: DataFrame, parts: DataFrame) -> DataFrame:
    """Every piece's place, by a search in the broadcast matches."""
    plan = np.array(sorted(map(tuple, matches.select("size", "rank", "first", "offset").collect())), np.int64).reshape(-1, 4)
    held, cols = parts.sparkSession.sparkContext.broadcast((plan[:, 0] << 40 | plan[:, 1], plan)), parts.columns

    def place(batches):
        keys, rows = held.value
        for b in batches:
            length, rank = b["length"].to_numpy(), b["__rank"].to_numpy()
            at = rows[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in cols), pa.array(at[:, 2] + rank - at[:, 1]), pa.array(at[:, 3])], [*cols, "sequence_id", "offset"])

    shape = ", ".join(f"{n} {t}" for n, t in parts.dtypes) + ", sequence_id long, offset long"
    return placed.select(*cols, "__rank").mapInArrow(place, shape)


def _merged(placed: DataFrame, matches: DataFrame, parts: DataFrame) -> DataFrame:
    """Every piece's place, by (length, block of PLACED ranks): a match is cut at the blocks' borders, and a piece takes the last one up to its rank."""
    block = F.explode(F.sequence(F.floor(F.col("rank") / PLACED), F.floor((F.col("rank") + F.col("n") - 1) / PLACED))).alias("__block")
    cut = matches.select(F.col("size").cast("long").alias("length"), block, "rank", F.struct(F.col("rank").alias("r"), "first", "offset").alias("__match"))
    cut = cut.withColumn("__rank", F.greatest("rank", F.col("__block") * PLACED)).drop("rank")
    pieces = placed.select(*parts.columns, "__rank", F.floor(F.col("__rank") / PLACED).alias("__block"))
    both = cut.unionByName(pieces, allowMissingColumns=True).withColumn("__piece", F.col("__match").isNull())
    before = W.partitionBy("length", "__block").orderBy("__rank", "__piece").rowsBetween(W.unboundedPreceding, 0)
    met = both.withColumn("__own", F.last("__match", ignorenulls=True).over(before)).where("__piece")
    return met.select(*parts.columns, (F.col("__own.first") + F.col("__rank") - F.col("__own.r")).alias("sequence_id"), F.col("__own.offset").cast("long").alias("offset"))
