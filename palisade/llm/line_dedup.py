r"""Line dedup: lines shared by many documents go, but for the last document that holds them.

A line's key is the line with white space stripped at both ends and A-Z lower-cased. Spark counts,
for each 128-bit key hash, the documents and the largest doc_id. Hashes of repeated lines are put
into an index of shards; a shard is a minimal perfect hash (levels of bit arrays, each holding the
keys that meet no other key there) over arrays of 64-bit fingerprints, counts and last documents.
Documents probe these arrays: the count tells whether a line is in enough documents. Below a checked size the
index is broadcast and texts stay where they are; beyond it, probes go to copies of the shards, as many as
a shard's probes need, and only line numbers come back.

Null and empty texts are one empty line and are kept. Rows with one doc_id count as one document
and are judged alike; so do those with a null doc_id, which is the smallest. Of rows tied for the largest doc_id all
keep their lines. Very long texts are cut whole, line by line. An empty table gives no rows. Extra columns, also of
clashing names, travel in the struct `row`.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import written

LEAST_CHARS, LEAST_DOCS = 20, 3
#: Keys a shard holds on average, and bytes an entry takes in the arrays.
SHARD_KEYS, ENTRY_BYTES = 1 << 15, 22
#: An index up to this size is broadcast.
BROADCAST_BYTES = 48 << 20
#: Beyond it, probes of a shard that one task takes, on average.
PROBED = 400_000
#: Counts in the arrays stop here.
MOST_COUNT = 65_535
NO_DOC = -(1 << 63)
_WHITE = b" \t\n\v\f\r"


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: place(keys) is one to one onto range(len(keys)).

    A level is a bit array in 64-bit words; a directory holds the number of set bits before each word, so a slot is one
    look into the directory and one popcount."""

    LEVELS, ROOM = 24, 2.0

    def __init__(self, keys: np.ndarray):
        self.words, self.before, self.sizes, left, placed = [], [], [], keys, 0
        for level in range(self.LEVELS):
            if not len(left):
                break
            m = 64 * max(1, -(-int(self.ROOM * len(left)) // 64))
            at = (_mix(left, level + 1) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            ones = np.bitwise_count(words)
            self.words.append(words)
            self.before.append((placed + np.cumsum(ones) - ones).astype(np.uint32))
            self.sizes.append(m)
            placed += int(ones.sum())
            left = left[~alone[at]]
        self.placed, self.rest = placed, np.sort(left)

    def place(self, keys: np.ndarray) -> np.ndarray:
        """A key's slot; for a key that was not built in, some slot or -1."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, before, m) in enumerate(zip(self.words, self.before, self.sizes, strict=True)):
            if not len(open_):
                return out
            at = _mix(keys[open_], level + 1) % np.uint64(m)
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            own = words[word]
            hit = (own & bit) != 0
            out[open_[hit]] = before[word[hit]] + np.bitwise_count(own[hit] & (bit[hit] - np.uint64(1))).astype(np.int64)
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            i = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[i] == keys[open_]
            out[open_[hit]] = self.placed + i[hit]
        return out


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and their keys; None for a key that is too short."""
    lines = (text or "").encode().split(b"\n")
    keys: list[bytes | None] = []
    for line in lines:
        key = line.strip(_WHITE).lower()
        long = len(key) >= LEAST_CHARS and (key.isascii() or len(key.decode()) >= LEAST_CHARS)
        keys.append(key if long else None)
    return lines, keys


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    a, b = xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest
    return np.fromiter((a(k, 42) for k in keys), np.uint64, len(keys)), np.fromiter((b(k, 7) for k in keys), np.uint64, len(keys))


def _lines_of(batches):
    """Distinct (key hash, fingerprint, doc_id) of each row."""
    for batch in batches:
        docs, keys = [], []
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            own = {k for k in line_keys(text)[1] if k is not None}
            keys += own
            docs += [NO_DOC if doc is None else doc] * len(own)
        h, f = _hashes(keys)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f.view(np.int64)), pa.array(docs, pa.int64())], ["h", "f", "doc"])


def repeated_lines(docs: DataFrame, least_docs: int = 2) -> DataFrame:
    """(h, f, n, last): hashes of lines in so many documents at least, with their number and the largest doc_id."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_lines_of, "h long, f long, doc long")
    return lines.groupBy("h", "f").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= least_docs)


def _build(pdf):
    import pandas as pd

    pdf = pdf.sort_values(["h", "f"])
    again = pdf["h"].duplicated()  # two keys under one 64-bit hash: the later ones are kept beside the arrays
    more = {(int(h), int(f)): (int(n), int(last)) for h, f, n, last in pdf.loc[again, ["h", "f", "n", "last"]].itertuples(index=False)}
    pdf = pdf[~again]
    keys = pdf["h"].to_numpy().view(np.uint64)
    mph = PerfectHash(keys)
    slot = mph.place(keys)
    arrays = []
    for column, kind in (("f", np.int64), ("last", np.int64), ("n", np.uint16)):
        out = np.zeros(len(keys), kind)
        out[slot] = np.minimum(pdf[column].to_numpy(), MOST_COUNT) if column == "n" else pdf[column].to_numpy()
        arrays.append(out.tobytes())
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "mph": [pickle.dumps((mph, more))], "finger": [arrays[0]], "last": [arrays[1]], "n": [arrays[2]]})


def build_index(lines: DataFrame, shards: int) -> DataFrame:
    def with_shard(batches):
        for b in batches:
            shard = _shard_of(b["h"].to_numpy().view(np.uint64), shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), b["h"], b["f"], b["n"], b["last"]], ["shard", "h", "f", "n", "last"])

    keyed = lines.select("h", "f", "n", "last").mapInArrow(with_shard, "shard int, h long, f long, n long, last long")
    return keyed.groupBy("shard").applyInPandas(_build, "shard int, mph binary, finger binary, last binary, n binary")


class Shard:
    """Arrays of fingerprints, counts and last documents behind a perfect hash."""

    def __init__(self, mph, finger, last, n):
        self.mph, self.more = pickle.loads(mph)
        self.finger, self.last, self.n = np.frombuffer(finger, np.int64), np.frombuffer(last, np.int64), np.frombuffer(n, np.uint16)

    def drops(self, h: np.ndarray, f: np.ndarray, doc: np.ndarray, least_docs: int) -> np.ndarray:
        """Which lines go: the fingerprint agrees, the count is large enough, and the document is not the last."""
        slot = self.mph.place(h)
        out = slot >= 0
        at, own = slot[out], f[out].view(np.int64)
        out[out] = (self.finger[at] == own) & (self.n[at] >= least_docs) & (self.last[at] != doc[out])
        if self.more:
            shared = np.array([k for k, _ in self.more], np.int64)
            for i in np.flatnonzero(np.isin(h.view(np.int64), shared)):
                n, last = self.more.get((int(h[i].view(np.int64)), int(f[i].view(np.int64))), (0, 0))
                out[i] |= n >= least_docs and last != doc[i]
        return out


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (_mix(h, 77) % np.uint64(shards)).astype(np.int64)


def _cut(lines: list[bytes], drop) -> str:
    return b"\n".join(x for x, gone in zip(lines, drop, strict=True) if not gone).decode()


SHAPE = "n_lines long, n_dropped long, kept string"


def drop_repeated_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(row, doc_id, n_lines, n_dropped, kept): row is the input row, kept the text that stays."""
    if not 2 <= least_docs <= MOST_COUNT:
        raise ValueError(f"least_docs must be from 2 to {MOST_COUNT}")
    spark = docs.sparkSession
    lines = written(repeated_lines(docs), "lines")
    n = lines.count()
    shards = max(1, -(-n // SHARD_KEYS))
    index = written(build_index(lines, shards), "line-index")
    base = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    row = base.schema["row"].dataType
    shape = T.StructType([T.StructField("row", row), T.StructField("doc_id", T.LongType()), *T._parse_datatype_string(SHAPE).fields])
    if n * ENTRY_BYTES <= broadcast_bytes:
        held = spark.sparkContext.broadcast({r["shard"]: tuple(r)[1:] for r in index.collect()})
        return base.mapInArrow(_probe_here(held, shards, least_docs), shape)
    return _probe_there(base, index, lines, shards, shape, least_docs)


def _finish(batch, drops):
    """The result's batch, given each document's lines and which of them go."""
    n, gone, kept = [], [], []
    for lines, drop in drops:
        n.append(len(lines))
        gone.append(int(sum(drop)))
        kept.append(_cut(lines, drop) if gone[-1] else b"\n".join(lines).decode())
    return pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["row", "doc_id", "n_lines", "n_dropped", "kept"])


def _probe_here(held, shards, least_docs):
    def probe(batches):
        index = {k: Shard(*v) for k, v in held.value.items()}
        for batch in batches:
            texts, keys, docs = [], [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                lines, own = line_keys(text)
                texts.append((lines, own))
                new = [k for k in own if k is not None]
                keys += new
                docs += [NO_DOC if doc is None else doc] * len(new)
            h, f = _hashes(keys)
            doc, drop = np.array(docs, np.int64), np.zeros(len(keys), bool)
            shard = _shard_of(h, shards)
            for s, part in index.items():
                at = np.flatnonzero(shard == s)
                drop[at] = part.drops(h[at], f[at], doc[at], least_docs)
            verdict = iter(drop.tolist())
            yield _finish(batch, ((lines, [k is not None and next(verdict) for k in own]) for lines, own in texts))

    return probe


def _salts(base: DataFrame, lines: DataFrame, shards: int) -> np.ndarray:
    """Copies of each shard: one for PROBED probes, of which a line common to n documents sends n to its own shard."""

    def common(batches):
        for b in batches:
            n = np.bincount(_shard_of(b["h"].to_numpy().view(np.uint64), shards), weights=b["n"].to_numpy(), minlength=shards)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at].astype(np.int64))], ["shard", "n"])

    every = base.agg(F.sum(F.size(F.split("text", "\n", -1)))).first()[0] or 0
    n = np.full(shards, every // shards, np.int64)
    # one number for each shard of 32,768 keys
    for shard, own in lines.select("h", "n").mapInArrow(common, "shard long, n long").groupBy("shard").agg(F.sum("n")).collect():
        n[shard] += own
    return 1 + n // PROBED


def _probe_there(base: DataFrame, index: DataFrame, lines: DataFrame, shards: int, shape, least_docs: int) -> DataFrame:
    """Probes sent to salted copies of the shards; the numbers of lines to drop come back by document."""
    base = base.withColumn("mark", F.xxhash64("text"))
    salts = _salts(base, lines, shards)

    def probes(batches):
        for batch in batches:
            out = {k: [] for k in ("doc", "mark", "line", "salt")}
            keys = []
            for doc, mark, text in zip(batch["doc_id"].to_pylist(), batch["mark"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for i, k in enumerate(line_keys(text)[1]):
                    if k is not None:
                        keys.append(k)
                        for name, v in (("doc", NO_DOC if doc is None else doc), ("mark", mark), ("line", i), ("salt", mark + i)):
                            out[name].append(v)
            h, f = _hashes(keys)
            shard = _shard_of(h, shards)
            salt = np.array([x & 0x7FFFFFFF for x in out["salt"]], np.int64) % salts[shard]
            yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int32()), "salt": pa.array(salt, pa.int32()), "doc": pa.array(out["doc"], pa.int64()), "mark": pa.array(out["mark"], pa.int64()), "line": pa.array(out["line"], pa.int32()), "h": pa.array(h.view(np.int64)), "f": pa.array(f.view(np.int64))})

    def judge(_, mine, theirs):
        if not len(theirs):
            return mine[["doc", "mark", "line"]].head(0)
        x = theirs.iloc[0]
        drop = Shard(x["mph"], x["finger"], x["last"], x["n"]).drops(mine["h"].to_numpy().view(np.uint64), mine["f"].to_numpy().view(np.uint64), mine["doc"].to_numpy(), least_docs)
        return mine.loc[drop, ["doc", "mark", "line"]]

    sent = base.select("doc_id", "mark", "text").mapInArrow(probes, "shard int, salt int, doc long, mark long, line int, h long, f long")

    def copied(batches):
        for b in batches:
            at = np.repeat(np.arange(b.num_rows), salts[b["shard"].to_numpy()])
            salt = np.arange(len(at)) - np.searchsorted(at, at)
            for i in range(len(at)):  # a copy at a time: a shard has about a megabyte
                yield pa.RecordBatch.from_arrays([*(c.slice(at[i], 1) for c in b.columns), pa.array(salt[i : i + 1], pa.int32())], [*b.schema.names, "salt"])

    copies = index.mapInArrow(copied, "shard int, mph binary, finger binary, last binary, n binary, salt int")
    gone = sent.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(judge, "doc long, mark long, line int")
    gone = gone.distinct().groupBy("doc", "mark").agg(F.collect_list("line").alias("gone")).withColumnRenamed("mark", "gone_mark")
    joined = base.join(gone, (F.coalesce(base["doc_id"], F.lit(NO_DOC)) == gone["doc"]) & (base["mark"] == gone["gone_mark"]), "left").select("row", "doc_id", "text", "gone")

    def finish(batches):
        for batch in batches:

            def drops(batch=batch):
                for text, gone in zip(batch["text"].to_pylist(), batch["gone"].to_pylist(), strict=True):
                    lines, drop = (text or "").encode().split(b"\n"), set(gone or ())
                    yield lines, [i in drop for i in range(len(lines))]

            yield _finish(batch, drops())

    return joined.mapInArrow(finish, shape)
