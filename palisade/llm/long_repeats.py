"""Long-repeat removal: bytes covered by a 100-byte string that also starts earlier in the corpus.

Run-length indexes do the matching, in parts. A first pass only sorts out what can match at all:

1. Each 100-byte window picks as its anchor the 32-byte substring of least hash in it (the rightmost
   of equals). Equal windows pick equal anchors at equal places. Windows in a row with one anchor form
   a region; a region is described by two independent 64-bit hashes (of the anchor, and of the whole region) and its place.
2. Regions are dealt out by anchor and sorted. An anchor with one region has no repeat. Equal regions are one string of the
   collection to index: the first stands for it, later ones are repeats in full, as a match with it covers all
   their windows. Where an anchor has several different regions, these are ambiguous.
3. The bytes of the ambiguous regions are dealt out by anchor. A task builds a run-length index of the
   regions of some anchors (run-compressed transform, sampled run ends), streams its matching
   statistics and marks what matches 100 bytes of an earlier region. An anchor with more than
   MOST_REGIONS different regions has its single windows dealt out by hash and sorted instead.
4. Marks come back to their documents, are merged, and the bytes are cut.

Equal regions and windows within a task are settled before the shuffle, so a passage that a third of
all documents share sends few rows. Sorted groups stream through a task with constant memory. Regions are taken for equal
when both hashes agree, 128 bits from two rolling hashes of unlike base and table; matches within an index are of the bytes.

Null and empty texts have no bytes. Documents are ordered by doc_id (null first), then by their text's 64-bit hash;
rows equal in both are one document and get the same result. Very long texts are cut into slices of CHUNK bytes that overlap.
Ties within a window go to the rightmost anchor. Cut bytes may split a character, so the
kept bytes are binary. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import whole_text, written
from palisade.llm.run_index import RunLengthIndex

LENGTH, ANCHOR = 100, 32
#: Bytes hashed at a time; longer documents are cut into slices that overlap by LENGTH - 1.
CHUNK = 1 << 20
#: Ambiguous regions of an anchor that one task compares at a time.
MOST_REGIONS = 2_000
NO_DOC = -(1 << 63)
_LOW = np.uint64(0xFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Rolling hashes of a byte array: hash of [a, b) in constant time from prefix sums."""

    def __init__(self, n: int, seed: int = 20240229):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, np.uint64)
        base = int(rng.integers(1 << 62, 1 << 63)) | 5
        self.power, self.inverse = (self._powers(b, n) for b in (base, pow(base, -1, 1 << 64)))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.empty(n, np.uint64)
        out[0] = 1
        done = 1
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        return out

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((sums[end] - sums[start]) * self.inverse[start])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def hashers(n: int) -> tuple[Hasher, Hasher]:
    """Two independent ones, for anchors and for whole regions."""
    return Hasher(n), Hasher(n, 20240301)


def regions(both: tuple[Hasher, Hasher], data: np.ndarray, ends: np.ndarray):
    """(start, windows, anchor hash, region hash) of each region of the strings that end at ends."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    hasher, second = both
    sums = hasher.sums(data)
    n = len(data) - ANCHOR + 1
    anchor = _mix((sums[ANCHOR:] - sums[:n]) * hasher.inverse[:n])
    key = (anchor & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))
    least = _sliding_least(key, LENGTH - ANCHOR + 1)
    valid = np.ones(len(data), bool)
    for e in ends.tolist():
        valid[max(0, e - LENGTH + 1) : e] = False
    at = np.flatnonzero(valid[: len(least)])
    if not len(at):
        return none, none, none.view(np.uint64), none.view(np.uint64)
    own = least[at]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    start = at[first]
    windows = np.diff(np.append(first, len(at)))
    place = (_LOW - (own[first] & _LOW)).astype(np.int64)
    whole = second.of(second.sums(data), start, start + windows + LENGTH - 1)
    shape = ((place - start) << 8 | windows).astype(np.uint64)
    return start, windows, anchor[place], _mix(whole ^ _mix(shape))


COLUMNS = ("marked", "k", "h", "doc", "tag", "start", "windows")
SHAPE = "marked boolean, k long, h long, doc long, tag long, start long, windows int"
KINDS = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())


def _batch(*columns):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], list(COLUMNS))


def _settled(k, h, doc, tag, start, windows):
    """Rows in place order, as a batch: the first of equal (k, h) stay open, later ones are marks, merged where they touch."""
    order = np.lexsort((np.arange(len(k)), h, k))
    same = np.zeros(len(k), bool)
    same[1:] = (k[order][1:] == k[order][:-1]) & (h[order][1:] == h[order][:-1])
    later = np.zeros(len(k), bool)
    later[order] = same
    # a row of the very same place as the one before it in its group is the same document given twice
    again = np.zeros(len(k), bool)
    o = order
    again[o[1:]] = same[1:] & (doc[o][1:] == doc[o][:-1]) & (tag[o][1:] == tag[o][:-1]) & (start[o][1:] == start[o][:-1])
    m = np.flatnonzero(later & ~again)
    live = np.flatnonzero(~later)
    if len(m):
        joins = (doc[m][1:] == doc[m][:-1]) & (tag[m][1:] == tag[m][:-1]) & (start[m][1:] == (start + windows)[m][:-1])
        head = np.flatnonzero(np.concatenate([[True], ~joins]))
        tail = np.append(head[1:], len(m)) - 1
        s, w = start[m][head], (start + windows)[m][tail] - start[m][head]
        d, t = doc[m][head], tag[m][head]
    else:
        s = w = d = t = np.empty(0, np.int64)
    spread = _mix(d.astype(np.int64).view(np.uint64) ^ s.astype(np.int64).view(np.uint64)).view(np.int64)
    return _batch(
        np.concatenate([np.zeros(len(live), bool), np.ones(len(s), bool)]),
        np.concatenate([k[live].view(np.int64), spread]),
        np.concatenate([h[live].view(np.int64), np.zeros(len(s), np.int64)]),
        np.concatenate([doc[live], d]), np.concatenate([tag[live], t]), np.concatenate([start[live], s]), np.concatenate([windows[live], w]),
    )


def _chunks(batches, extra=None):
    """(data, ends, doc, tag, base[, extra]) of texts in document order, about CHUNK bytes at a time."""

    def close(items):
        size = np.cumsum([len(x[3]) for x in items])
        return np.frombuffer(b"".join(x[3] for x in items), np.uint8), size, items

    for b in batches:
        rows = sorted(zip(b["doc"].to_pylist(), b["tag"].to_pylist(), b["text"].to_pylist(), b[extra].to_pylist() if extra else itertools.repeat(None)), key=lambda r: r[:2])
        items, total, place, texts = [], 0, None, set()
        for doc, tag, text, more in rows:
            if (doc, tag) != place:
                place, texts = (doc, tag), set()
            if text in texts:  # the same document given twice has the same regions
                continue
            texts.add(text)
            raw = text.encode()
            for at in range(0, max(1, len(raw)), CHUNK):
                part = raw[at : at + CHUNK + LENGTH - 1]
                if len(part) >= LENGTH:
                    items.append((doc, tag, at, part, more))
                    total += len(part)
                if total >= CHUNK:
                    yield close(items)
                    items, total = [], 0
        if items:
            yield close(items)


def _find_regions(batches):
    both = hashers(2 * CHUNK + 2 * LENGTH)
    for data, ends, items in _chunks(batches):
        start, windows, k, h = regions(both, data, ends)
        which = np.searchsorted(ends, start, side="right")
        doc, tag, base = (np.array([x[i] for x in items], np.int64) for i in range(3))
        start = start - np.concatenate([[0], ends[:-1]])[which] + base[which]
        yield _settled(k, h, doc[which], tag[which], start, windows)


def _judge(batches):
    """Sorted rows: open rows that repeat become marks; first ones whose k has several h go on as ambiguous, h then is
    their number within k."""
    last = None  # (k, h, doc, tag, start) of the last open row
    pending = None  # the last first row, and its number within its k
    for b in itertools.chain(batches, [None]):
        if b is None:
            if pending is not None and pending[1]:
                k, doc, tag, start, windows = pending[0]
                yield _batch([False], [k], [pending[1]], [doc], [tag], [start], [windows])
            return
        marked = b["marked"].to_numpy(zero_copy_only=False)
        k, h, doc, tag, start, windows = (b[c].to_numpy() for c in COLUMNS[1:])
        i = np.flatnonzero(~marked)
        if not len(i):
            yield b
            continue
        cols = [x[i] for x in (k, h, doc, tag, start)]
        before = [np.concatenate([[v], x[:-1]]) for v, x in zip(last or [x[0] for x in cols], cols, strict=True)]
        equal = [x == y for x, y in zip(cols, before, strict=True)]
        same = equal[0] & equal[1]
        again = same & equal[2] & equal[3] & equal[4]
        if last is None:
            same[0] = again[0] = False
        last = [x[-1] for x in cols]
        repeat = i[same & ~again]
        heads = i[~same]
        out = [np.flatnonzero(marked), repeat]
        amb, amb_n = [], []
        if len(heads):
            hk = k[heads]
            linked = np.concatenate([[pending is not None and pending[0][0] == hk[0]], hk[1:] == hk[:-1]])
            if pending is not None and (pending[1] or linked[0]):
                amb, amb_n = [pending[0]], [pending[1]]
            begin = np.maximum.accumulate(np.where(linked, 0, np.arange(len(hk))))
            number = np.arange(len(hk)) - begin + np.where((begin == 0) & linked[0], pending[1] + 1 if pending is not None else 0, 0)
            several = linked.copy()
            several[:-1] |= linked[1:]
            keep, keep_n = heads[:-1][several[:-1]], number[:-1][several[:-1]]
            pending = tuple(x[heads[-1]].item() for x in (k, doc, tag, start, windows)), int(number[-1])
        else:
            keep, keep_n = heads, np.empty(0, np.int64)
        got = np.concatenate([*out, keep])
        a = [np.array([x[c] for x in amb], np.int64) for c in range(5)]
        yield _batch(
            np.concatenate([np.ones(len(got) - len(keep), bool), np.zeros(len(keep) + len(amb), bool)]),
            np.concatenate([k[got], a[0]]), np.concatenate([np.zeros(len(got) - len(keep), np.int64), keep_n, np.array(amb_n, np.int64)]), np.concatenate([doc[got], a[1]]),
            np.concatenate([tag[got], a[2]]), np.concatenate([start[got], a[3]]), np.concatenate([windows[got], a[4]]),
        )


def _find_windows(batches):
    """Hashes of every window of the regions that came with each text."""
    second = hashers(2 * CHUNK + 2 * LENGTH)[1]
    for data, ends, items in _chunks(batches, "regions"):
        sums = second.sums(data)
        at, k, doc, tag, place = [], [], [], [], []
        for (d, t, base, part, own), end in zip(items, ends.tolist(), strict=True):
            begin = end - len(part)
            s = np.array([r["start"] for r in own], np.int64)
            w = np.array([r["windows"] for r in own], np.int64)
            a = np.array([r["k"] for r in own], np.int64)
            here = (s >= base) & (s < base + CHUNK)
            s, w, a = s[here], w[here], a[here]
            if not len(s):
                continue
            pos = np.repeat(s - np.concatenate([[0], np.cumsum(w)[:-1]]), w) + np.arange(w.sum())
            order = np.argsort(pos, kind="stable")
            place.append(pos[order])
            at.append(pos[order] - base + begin)
            k.append(np.repeat(a, w)[order])
            doc.append(np.full(len(pos), d))
            tag.append(np.full(len(pos), t))
        if not at:
            continue
        at, k, doc, tag, place = map(np.concatenate, (at, k, doc, tag, place))
        yield _settled(k.view(np.uint64), second.of(sums, at, at + LENGTH), doc, tag, place, np.ones(len(at), np.int64))


BYTES = "k long, doc long, tag long, start long, windows int, raw binary"


def _region_bytes(batches):
    for b in batches:
        rows = []
        for doc, tag, text, own in zip(b["doc"].to_pylist(), b["tag"].to_pylist(), b["text"].to_pylist(), b["regions"].to_pylist(), strict=True):
            raw = text.encode()
            rows += [(r["k"], doc, tag, r["start"], r["windows"], raw[r["start"] : r["start"] + r["windows"] + LENGTH - 1]) for r in own]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["k", "doc", "tag", "start", "windows", "raw"])


def _compare(batches):
    """Marks of the windows that come again among the regions of each anchor; rows sorted by anchor and place."""
    held = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if held is None or not held.num_rows:
            continue
        k = held["k"].to_numpy()
        done = len(k) if b is None else int(np.searchsorted(k, k[-1]))  # the last anchor may go on
        if not done:
            continue
        part, held = held.slice(0, done), held.slice(done)
        k, doc, tag, start = (part[c].to_numpy() for c in ("k", "doc", "tag", "start"))
        fresh = np.ones(done, bool)  # a document given twice has its regions twice
        fresh[1:] = (k[1:] != k[:-1]) | (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] != start[:-1])
        k, doc, tag, start = k[fresh], doc[fresh], tag[fresh], start[fresh].astype(np.int64)
        index = RunLengthIndex(part["raw"].filter(pa.array(fresh)).to_pylist())
        at = index.repeated(LENGTH)
        if not len(at):
            continue
        own = np.searchsorted(index.end, at, side="right")
        head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])]))
        first, which, n = at[head], own[head], np.diff(np.append(head, len(at)))
        yield _batch(np.ones(len(head), bool), k[which], np.zeros(len(head), np.int64), doc[which], tag[which], start[which] + first - index.start[which], n)


def _sorted_out(rows: DataFrame) -> DataFrame:
    order = ("marked", "k", "h", "doc", "tag", "start")
    return rows.repartition("k", "marked").sortWithinPartitions(*order).mapInArrow(_judge, SHAPE)


def _by_window(rows: DataFrame) -> DataFrame:
    return rows.repartition("k", "h").sortWithinPartitions("marked", "k", "h", "doc", "tag", "start").mapInArrow(_judge, SHAPE).where("marked")


def repeats(docs: DataFrame, most_regions: int = MOST_REGIONS) -> DataFrame:
    """(doc, tag, start, windows): windows that also start earlier; docs has doc, tag, text."""
    found = written(_sorted_out(docs.mapInArrow(_find_regions, SHAPE)), "regions")

    def texts(rows):
        own = rows.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "windows", "k")).alias("regions"))
        return docs.join(own.hint("shuffle_hash"), ["doc", "tag"]).select("doc", "tag", "text", "regions")

    open_ = found.where("not marked")
    crowded = open_.where(F.col("h") == most_regions).select("k")
    marks = found.where("marked")
    if crowded.limit(1).count():
        marks = marks.union(_by_window(texts(open_.join(crowded, "k", "left_semi")).mapInArrow(_find_windows, SHAPE)))
        open_ = open_.join(crowded, "k", "left_anti")
    cut = texts(open_).mapInArrow(_region_bytes, BYTES)
    compared = cut.repartition("k").sortWithinPartitions("k", "doc", "tag", "start").mapInArrow(_compare, SHAPE).where("marked")
    return marks.union(compared).select("doc", "tag", "start", "windows")


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _removed(n: int, marks) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    start = np.array([m["start"] for m in marks], np.int64)
    windows = np.array([m["windows"] for m in marks], np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + windows + LENGTH - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, digest: bool = False, most_regions: int = MOST_REGIONS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept is the bytes that stay, or with digest their SHA-256 in hex."""
    text = whole_text(docs)
    src = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_DOC)).alias("doc"),
        F.xxhash64(text).alias("tag"), text.alias("text"),
    )
    marks = repeats(src.select("doc", "tag", "text"), most_regions).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "windows")).alias("marks"))
    joined = src.join(marks.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc_id", "text", "marks")

    def cut(batches):
        for b in batches:
            rows = []
            for doc, text, marks in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["marks"].to_pylist(), strict=True):
                raw, removed, spans = text.encode(), 0, 0
                n = len(raw)
                if marks:
                    gone = _removed(n, marks)
                    removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((doc, n, removed, spans, hashlib.sha256(raw).hexdigest() if digest else raw))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, OUT.replace("binary", "string") if digest else OUT)
