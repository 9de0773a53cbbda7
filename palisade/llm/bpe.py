"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

In a text's merge result every two neighbouring tokens are the merge result of their own bytes, and
only one token ends each prefix in that way. So after each byte exactly one token closes at that
place, given the token that closes where it begins. A state of the transducer holds the open places
(those at which a longer token may still begin), each with its last token and the tokens between it
and the last settled place. Reading a byte closes one token, drops places that no token of the
vocabulary can grow from, and emits the tokens that all open places agree on; so output lags by less
than the longest token. States and their transitions are made when first met and kept in a bounded
table that starts anew when full; results do not depend on it.

Decoding turns ids into bytes piece by piece; an incremental UTF-8 decoder carries a character that
is split between pieces.

Null and empty texts have no tokens. Repeated rows are encoded alike; extra columns are ignored.
Very long texts are encoded whole, piece by piece of the splitting pattern; of tied merges the one of lower rank that stands further left goes first,
as ranks are distinct. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of a worker's tables: transitions, judged pairs, whole matches with their ids.
MOST_STATES, MOST_PAIRS, MOST_WORDS, WORD_BYTES = 200_000, 1_000_000, 1 << 19, 32
START = -1
DECODE_IDS = 1 << 14


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.grows = {b[:i] for b in ranks for i in range(len(b))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._empty_table()

    def _empty_table(self) -> None:
        self.number = {((0, START, ()),): 0}
        self.states = [(b"", ((0, START, ()),))]
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merged(self, text: bytes) -> list[int]:
        """The merge result by definition, for short strings."""
        parts, ranks = [text[i : i + 1] for i in range(len(text))], self.ranks
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[p] for p in parts]

    def fits(self, last: int, token: int) -> bool:
        key = (last, token)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            want = [token] if last == START else [last, token]
            known = self.pairs[key] = self.merged(b"".join(self.bytes_of[t] for t in want)) == want
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        suffix, open_ = self.states[state]
        suffix += bytes([byte])
        closed, still = None, []
        for size, last, pending in open_:
            s = suffix[len(suffix) - size - 1 :]
            token = self.ranks.get(s)
            if closed is None and token is not None and self.fits(last, token):
                closed = (0, token, (*pending, token))
            if s in self.grows:
                still.append((size + 1, last, pending))
        assert closed is not None, "a byte is not in the vocabulary"
        still.append(closed)
        n = 0
        shortest = min(len(p) for _, _, p in still)
        while n < shortest and len({p[n] for _, _, p in still}) == 1:
            n += 1
        emitted = closed[2][:n]
        still = tuple((size, last, pending[n:]) for size, last, pending in still)
        suffix = suffix[len(suffix) - still[0][0] :]
        key = (suffix, still)
        if (at := self.number.get(key)) is None:
            at = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        self.moves[state][byte] = at, emitted
        return at, emitted

    def encode(self, word: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if len(self.states) > MOST_STATES:
            self._empty_table()
        state, out, moves = 0, [], self.moves
        for byte in word:
            move = moves[state].get(byte)
            if move is None:
                if len(self.states) > 2 * MOST_STATES:  # within one very long match: keep the state, drop the table
                    held = self.states[state]
                    self._empty_table()
                    moves, state = self.moves, len(self.states)
                    self.states.append(held)
                    self.moves.append({})
                    self.number[held] = state
                move = self._move(state, byte)
            state, emitted = move
            if emitted:
                out += emitted
        return out + list(self.states[state][1][-1][2])


class Encoder:
    """ids of whole texts, each match of the pattern separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.transducer, self.find, self.known = Transducer(ranks), regex.compile(pattern).findall, {}

    def __call__(self, text: str) -> bytes:
        known, encode, out = self.known, self.transducer.encode, []
        for word in self.find(text):
            ids = known.get(word)
            if ids is None:
                ids = np.array(encode(word.encode()), "<u4").tobytes()
                if len(word) <= WORD_BYTES:
                    if len(known) >= MOST_WORDS:
                        known.clear()
                    known[word] = ids
            out.append(ids)
        return b"".join(out)


def decode_stream(chunks, bytes_of):
    """Text pieces of id chunks; a character split between chunks comes with the later one."""
    utf8 = codecs.getincrementaldecoder("utf-8")("replace")
    for ids in chunks:
        yield utf8.decode(b"".join([bytes_of[i] for i in ids]))
    yield utf8.decode(b"", True)


@functools.cache
def _tables(path: str, pattern: str):
    ranks = read_ranks(path)
    top = max(ranks.values(), default=-1) + 1
    table = [b""] * top
    for b, i in ranks.items():
        table[i] = b
    return Encoder(ranks, pattern), table


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): little-endian unsigned 32-bit ids, and the text that streaming decoding gives back."""

    def run(batches):
        encoder, table = _tables(ranks_path, pattern)
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"].to_pylist(), strict=True):
                ids = encoder(text or "")
                each = np.frombuffer(ids, "<u4").tolist()
                decoded = "".join(decode_stream((each[i : i + DECODE_IDS] for i in range(0, len(each), DECODE_IDS)), table))
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), pa.array([ids], pa.binary()), pa.array([decoded], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), digested where the ids are made."""

    def run(batches):
        encoder, table = _tables(ranks_path, pattern)
        for b in batches:
            n, digests, back = [], [], []
            for text in b["text"].to_pylist():
                ids = encoder(text or "")
                each = np.frombuffer(ids, "<u4").tolist()
                sha = hashlib.sha256()
                for piece in decode_stream((each[i : i + DECODE_IDS] for i in range(0, len(each), DECODE_IDS)), table):
                    sha.update(piece.encode())
                n.append(len(each))
                digests.append(hashlib.sha256(ids).hexdigest())
                back.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(digests), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
