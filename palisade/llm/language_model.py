"""Language-model scoring: a log-bilinear model trained in numpy with noise-contrastive estimation.

Words are lower-cased (A-Z) runs without ASCII white space; each text ends with one end token. Counts
of every word of the training texts are made by Spark over 64-bit word hashes. The most frequent words are
modelled, VOCABULARY * tokens ** GROWTH of them, so the model grows with the corpus. They are dealt by
frequency into about the square root of their number of classes. The other words form a fixed number of rare
classes by their last two bytes, in which a word has its smoothed count's share, one share being kept for unseen words.

The log-bilinear part predicts from the words before: their vectors, scaled elementwise by position, sum to a
prediction. Its products with the vectors of the classes, the end token and the rare classes give the first factor of
a word's probability, those with the vectors of the words of its class the second. Each factor is normalised over all
its outcomes, so the probabilities of all words given a context sum to one, at the cost of two small matrix products.

Both factors are trained with noise samples from the outcomes' frequencies: every task learns every position of all
its training texts, from a common start, and Spark averages the tasks' parameters in blocks. The start is learnt in one
task on distinct texts of about WARM_TOKENS tokens and at most WARM_BYTES bytes. Tasks are as few as make the
parameters they send at most SENT of their texts.

Counts of rare words are broadcast while their checked size allows; beyond it texts send their rare
words to a join and only sums come back.

Null and empty texts are one end token. Very long texts are read whole. A null doc_id counts as training text. Repeated rows count and
score each. Of words with equal counts those of smaller hash are modelled first. Extra columns are ignored, whatever their names. Without any training text every count is 0 and the outcomes are
equally likely. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import written
from palisade.llm.long_repeats import Hasher, _mix

#: Modelled words: VOCABULARY * (training tokens) ** GROWTH. Rare classes of the others.
VOCABULARY, GROWTH, RARE = 4, 0.4, 32
CONTEXT, SIZE = 6, 32
#: Noise samples that a batch shares for the first factor, and of each position for the second.
NOISE, OWN_NOISE = 64, 2
BATCH, RUN, STEP, EPOCHS = 4096, 64, 0.2, 2
#: The start's texts: about so many tokens, characters of a text, and bytes at most.
WARM_TOKENS, WARM_TEXT, WARM_BYTES = 400_000, 1 << 16, 4 << 20
#: Parameters sent to be averaged, as a part of the texts' bytes; floats of a block; tasks averaged at a time.
SENT, AVERAGED, FAN_IN = 0.1, 1 << 16, 64
CHUNK, BLOCK = 1 << 20, 4096
#: Rare words' hashes and counts up to this size are broadcast.
BROADCAST_BYTES, ENTRY_BYTES = 96 << 20, 16
END_HASH = np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RARE_CLASS = (_mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(99)) % np.uint64(RARE)).astype(np.int64)


class Texts:
    """Words of many texts at once: hashes, classes and the text each belongs to, an end token after each text."""

    def __init__(self):
        self.hasher = Hasher(2 * CHUNK)

    def words(self, texts: list[bytes]):
        data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        if len(self.hasher.power) < len(data):
            self.hasher = Hasher(len(data))
        space = _SPACE[data]
        edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
        start = np.flatnonzero(edge == -1)
        end = np.flatnonzero(edge == 1)
        h = self.hasher.of(self.hasher.sums(data), start, end)
        h[h == END_HASH] = np.uint64(2)
        cls = _RARE_CLASS[data[end - 1].astype(np.int64) << 8 | np.where(end - start > 1, data[end - 2], 0)]
        size = np.array([len(t) + 1 for t in texts], np.int64)
        owner = np.searchsorted(np.cumsum(size), start, side="right")
        n = np.bincount(owner, minlength=len(texts))
        at = np.cumsum(n)  # end tokens go behind each text's words
        return np.insert(h, at, END_HASH), np.insert(cls, at, 0), n + 1


def _chunks(batches, *columns):
    """(texts as bytes, the columns' values) of about CHUNK bytes."""
    for b in batches:
        texts, other, total = [], [[] for _ in columns], 0
        for row in zip(b["text"].to_pylist(), *(b[c].to_pylist() for c in columns), strict=True):
            texts.append((row[0] or "").encode())
            for o, v in zip(other, row[1:], strict=True):
                o.append(v)
            total += len(texts[-1])
            if total >= CHUNK:
                yield texts, other
                texts, other, total = [], [[] for _ in columns], 0
        if texts:
            yield texts, other


def _count(batches):
    reader, held = Texts(), []

    def merged(parts):
        h, c, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return u, c[first], np.bincount(inverse, weights=n).astype(np.int64)

    for texts, _ in _chunks(batches):
        h, c, _ = reader.words(texts)
        u, first, n = np.unique(h, return_index=True, return_counts=True)
        held.append((u, c[first], n))
        if sum(len(x[0]) for x in held) > 1 << 20:
            held = [merged(held)]
            if len(held[0][0]) > 1 << 19:
                yield _counted(held.pop())
    if held:
        yield _counted(merged(held))


def _counted(x):
    return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1], pa.int32()), pa.array(x[2], pa.int64())], ["h", "cls", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, cls, n) of every word of the texts."""
    return texts.select("text").mapInArrow(_count, "h long, cls int, n long").groupBy("h").agg(F.first("cls").alias("cls"), F.sum("n").alias("n"))


class Vocabulary:
    """The modelled words by hash, frequent ones first, dealt into classes; rare classes' totals, N and V.

    Symbols: the modelled words, then the end token, then the rare classes. Outcomes of the first factor: the classes of
    modelled words, then the end token, then the rare classes."""

    def __init__(self, h, n, rare_total, tokens, types, ends):
        self.n, self.size, self.end = n, len(n), len(n)
        self.order = np.argsort(h)
        self.sorted = h[self.order]
        self.rare_total, self.tokens, self.types, self.ends = rare_total, tokens, types, ends
        mass = np.cumsum(n) - n / 2
        classes = max(1, round(math.sqrt(self.size)))
        cls = np.unique((mass * classes / max(1, n.sum())).astype(np.int64), return_inverse=True)[1] if self.size else np.empty(0, np.int64)
        self.classes = int(cls[-1]) + 1 if self.size else 0
        #: A class has the words from first[c] up to first[c + 1].
        self.first = np.searchsorted(cls, np.arange(self.classes + 1))
        self.outcome = np.concatenate([cls, self.classes + np.arange(1 + RARE)]).astype(np.int32)
        count = np.concatenate([np.bincount(cls, weights=n, minlength=self.classes), [ends], np.maximum(0, rare_total - 1)]) + 0.5
        self.frequency = count / count.sum()
        inside = np.bincount(cls, weights=n + 0.5, minlength=self.classes)
        self.share = (n + 0.5) / inside[cls] if self.size else np.empty(0)

    def symbols(self, h: np.ndarray, rare: np.ndarray) -> np.ndarray:
        out = (self.end + 1 + rare).astype(np.int32)
        if self.size:
            i = np.minimum(np.searchsorted(self.sorted, h), self.size - 1)
            own = self.sorted[i] == h
            out[own] = self.order[i[own]]
        out[h == END_HASH] = self.end
        return out


def _grouped(index: np.ndarray):
    """(distinct values, order, where each value begins in the order)."""
    order = np.argsort(index, kind="stable")
    ranked = index[order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return ranked[head], order, head


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


class LogBilinear:
    def __init__(self, vocabulary: Vocabulary, seed: int = 3):
        rng = np.random.default_rng(seed)
        v = self.vocabulary = vocabulary
        self.context = rng.normal(0, 0.1, (v.size + 1 + RARE, SIZE)).astype(np.float32)
        self.position = np.ones((CONTEXT, SIZE), np.float32)
        self.target = rng.normal(0, 0.02, (len(v.frequency), SIZE)).astype(np.float32)
        self.bias = np.log(v.frequency).astype(np.float32)
        self.word = rng.normal(0, 0.02, (v.size, SIZE)).astype(np.float32)
        self.word_bias = np.log(v.share).astype(np.float32)
        self.sums = [np.full(x.shape, 1e-3, np.float32) for x in self.parts()]
        self.shift, self.word_shift = np.log(NOISE * v.frequency).astype(np.float32), np.log(OWN_NOISE * v.share).astype(np.float32)
        self.up_to = np.concatenate([[0], np.cumsum(v.share)])  # every class has mass one

    def parts(self):
        return self.context, self.position, self.target, self.bias, self.word, self.word_bias

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for x in self.parts():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    def _step(self, which: int, gradient: np.ndarray, rows=slice(None)) -> None:
        """AdaGrad on some rows of a part."""
        s = self.sums[which][rows] + gradient * gradient
        self.sums[which][rows] = s
        self.parts()[which][rows] -= STEP * gradient / np.sqrt(s)

    def own_noise(self, out: np.ndarray, rng) -> np.ndarray:
        """OWN_NOISE words for each modelled word of out, drawn from its class by frequency."""
        c = self.vocabulary.outcome[out]
        u = c[:, None] + rng.random((len(out), OWN_NOISE))
        # a class's mass is one, so its words lie between c and c + 1
        got = np.searchsorted(self.up_to, u, side="right") - 1
        first = self.vocabulary.first
        return np.clip(got, first[c][:, None], first[c + 1][:, None] - 1)

    def learn(self, tokens: np.ndarray, real: np.ndarray, noise: np.ndarray, rng) -> None:
        """One step of noise-contrastive estimation on runs of symbols, each behind its first CONTEXT ones; real tells
        which are learnt. The runs share the noise of the first factor."""
        v = self.vocabulary
        sample, times = np.unique(noise, return_counts=True)
        n, width = max(1, int(real.sum())), real.shape[1]
        found = self.context.take(tokens, axis=0)
        before = [slice(CONTEXT - 1 - j, CONTEXT - 1 - j + width) for j in range(CONTEXT)]
        h = sum(found[:, w] * self.position[j] for j, w in enumerate(before)).reshape(-1, SIZE)
        symbol, weight = tokens[:, CONTEXT:].ravel(), (real.ravel() / n).astype(np.float32)
        out = v.outcome[symbol]
        own, other = self.target.take(out, axis=0), self.target[sample]
        good = (h * own).sum(axis=1) + (self.bias - self.shift)[out]
        bad = h @ other.T
        bad += self.bias[sample] - self.shift[sample]
        g = _sigmoid(bad)
        g *= times.astype(np.float32)
        g *= weight[:, None]
        g_own = -_sigmoid(-good) * weight
        dh = g @ other
        dh += g_own[:, None] * own
        dt, db = np.zeros_like(self.target), np.bincount(out, weights=g_own, minlength=len(self.bias)).astype(np.float32)
        rows, order, head = _grouped(out)
        dt[rows] = np.add.reduceat((g_own[:, None] * h).take(order, axis=0), head)
        dt[sample] += g.T @ h
        db[sample] += g.sum(axis=0)
        # the second factor: each modelled word against words of its class
        at = np.flatnonzero((symbol < v.end) & (weight > 0))
        if len(at):
            all_ = np.concatenate([symbol[at][:, None], self.own_noise(symbol[at], rng)], axis=1)
            vectors, hw = self.word.take(all_, axis=0), h[at]
            z = np.einsum("nks,ns->nk", vectors, hw) + (self.word_bias - self.word_shift)[all_]
            gw = _sigmoid(z)
            gw[:, 0] -= 1
            gw *= weight[at][:, None]
            dh[at] += np.einsum("nk,nks->ns", gw, vectors)
            rows, order, head = _grouped(all_.ravel())
            flat = gw.ravel()
            flat = flat[order]
            self._step(4, np.add.reduceat(hw.take(order // (1 + OWN_NOISE), axis=0) * flat[:, None], head), rows)
            self._step(5, np.add.reduceat(flat, head), rows)
        dh = dh.reshape(*real.shape, SIZE)
        d, dp = np.zeros_like(found), np.empty_like(self.position)
        for j, w in enumerate(before):
            d[:, w] += dh * self.position[j]
            dp[j] = np.einsum("rns,rns->s", dh, found[:, w])
        rows, order, head = _grouped(tokens.ravel())
        self._step(0, np.add.reduceat(d.reshape(-1, SIZE).take(order, axis=0), head), rows)
        for which, x in ((1, dp), (2, dt), (3, db)):
            self._step(which, x)

    def predictions(self, before: np.ndarray) -> np.ndarray:
        h = self.context.take(before[:, 0], axis=0) * self.position[0]
        for j in range(1, CONTEXT):
            h += self.context.take(before[:, j], axis=0) * self.position[j]
        return h

    def log10(self, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each symbol given those before it."""
        v, h = self.vocabulary, self.predictions(before)
        out = v.outcome[symbol]
        got = _log_softmax(h, self.target, self.bias, out)
        words = np.flatnonzero(symbol < v.end)
        words = words[np.argsort(out[words], kind="stable")]  # a class's words together
        edges = np.searchsorted(out[words], np.arange(v.classes + 1))
        for c in np.flatnonzero(np.diff(edges)):
            a, b = v.first[c], v.first[c + 1]
            if b - a > 1:
                at = words[edges[c] : edges[c + 1]]
                got[at] += _log_softmax(h[at], self.word[a:b], self.word_bias[a:b], symbol[at] - a)
        return got / np.log(10)


def _log_softmax(h: np.ndarray, vectors: np.ndarray, bias: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Natural log of the probability of which[i] among the vectors, given prediction h[i]; in blocks of bounded size."""
    got, block = np.empty(len(h)), max(1, BLOCK * 256 // len(bias))
    for i in range(0, len(h), block):
        z = h[i : i + block] @ vectors.T
        z += bias
        z -= z.max(axis=1, keepdims=True)
        own = z[np.arange(len(z)), which[i : i + block]].astype(np.float64)
        np.exp(z, out=z)
        got[i : i + block] = own - np.log(z.sum(axis=1, dtype=np.float64))
    return got


def contexts(symbols: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The CONTEXT symbols before each, the end token standing before a text's first."""
    inside = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = np.full((len(symbols), CONTEXT), end, np.int32)
    for j in range(1, CONTEXT + 1):
        before[j:, j - 1] = np.where(inside[j:] >= j, symbols[:-j], end)
    return before


def runs(symbols: np.ndarray, sizes: np.ndarray, end: int):
    """(tokens, real): the symbols as runs of RUN, each row behind the CONTEXT ones before it. Texts are set apart by
    end tokens, so that no context reaches the text before; those, and what fills the last run, are not real."""
    ends = np.cumsum(sizes)
    total = len(symbols) + (CONTEXT - 1) * (len(sizes) - 1)
    rows = -(-total // RUN)
    stream, real = np.full(CONTEXT + rows * RUN, end, np.int32), np.zeros(rows * RUN, bool)
    at = np.arange(len(symbols)) + np.repeat(np.arange(len(sizes)) * (CONTEXT - 1), np.diff(ends, prepend=0))
    stream[CONTEXT + at], real[at] = symbols, True
    return np.lib.stride_tricks.sliding_window_view(stream, CONTEXT + RUN)[::RUN], real.reshape(rows, RUN)


BLOCKS = "learner long, i int, n long, p binary"


def _training(vocabulary, start, epochs=1, most_bytes=None):
    """Learns every position of the task's texts; with most_bytes of that many bytes of them, held for several epochs.

    Its parameters come out in blocks, each with the number of positions learnt."""

    def bounded(chunks):
        left = most_bytes
        for texts, _ in chunks:
            kept = list(itertools.takewhile(lambda x: x[1] <= left, zip(texts, itertools.accumulate(map(len, texts)), strict=True)))
            if kept:
                yield [t for t, _ in kept], []
                left -= kept[-1][1]
            if len(kept) < len(texts):
                return

    def run(batches):
        from pyspark import TaskContext

        words = vocabulary.value
        model, reader, rng = LogBilinear(words), Texts(), np.random.default_rng(5)
        if start is not None:
            model.load(start.value)
            for s in model.sums:
                s += 0.05  # small steps from a trained start
        seen, up_to = 0, np.cumsum(words.frequency)
        chunks = _chunks(batches) if most_bytes is None else itertools.chain.from_iterable(itertools.repeat(list(bounded(_chunks(batches))), epochs))
        for texts, _ in chunks:
            h, rare, sizes = reader.words(texts)
            tokens, real = runs(words.symbols(h, rare), sizes, words.end)
            order, step = rng.permutation(len(tokens)), BATCH // RUN
            noise = np.minimum(np.searchsorted(up_to, rng.random((-(-len(order) // step), NOISE))), len(up_to) - 1)
            for i in range(0, len(order), step):
                at = order[i : i + step]
                model.learn(tokens[at], real[at], noise[i // step], rng)
            seen += int(real.sum())
        if seen:
            flat, own = model.flat(), TaskContext.get().partitionId()
            for i in range(0, len(flat), AVERAGED):
                row = [own], [i // AVERAGED], [seen], [flat[i : i + AVERAGED].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["learner", "i", "n", "p"])

    return run


def _averaged(rows: DataFrame, learners: int) -> np.ndarray | None:
    """The parameters' mean by positions learnt; blocks of at most FAN_IN tasks meet at a time."""

    def mean(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("learner", kind="stable")  # sums in one order
        n = pdf["n"].to_numpy()
        total = sum(w * np.frombuffer(p, np.float32).astype(np.float64) for w, p in zip(n / n.sum(), pdf["p"], strict=True))
        return pd.DataFrame({"learner": [0], "i": [pdf["i"].iloc[0]], "n": [int(n.sum())], "p": [total.astype(np.float32).tobytes()]})

    while learners > 1:
        learners = -(-learners // FAN_IN)
        rows = rows.withColumn("team", F.pmod("learner", F.lit(learners))).groupBy("i", "team").applyInPandas(lambda key, pdf: mean(key, pdf).assign(learner=key[1]), BLOCKS)
    got = sorted((r["i"], bytes(r["p"])) for r in rows.select("i", "p").collect())
    return np.frombuffer(b"".join(p for _, p in got), np.float32) if got else None


def fit(train: DataFrame, counts: DataFrame) -> tuple[Vocabulary, LogBilinear]:
    """The model from the training texts and their word counts."""
    spark = train.sparkSession
    total = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("h") == int(END_HASH), F.col("n")))).first()
    tokens, types, ends = (int(x or 0) for x in total)
    words = counts.where(F.col("h") != int(END_HASH))
    size = int(VOCABULARY * tokens**GROWTH)
    top = words.orderBy(F.desc("n"), "h").limit(size).select("h", "n").toPandas()
    rare = words.where("false")
    if len(top) == size and size:
        least, last = int(top["n"].iloc[-1]), int(top["h"].iloc[-1])
        rare = words.where((F.col("n") < least) | ((F.col("n") == least) & (F.col("h") > last)))
    rare_n, rare_v = np.zeros(RARE), np.zeros(RARE)
    for r in rare.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        rare_n[r["cls"]], rare_v[r["cls"]] = r["n"], r["v"]
    vocabulary = Vocabulary(top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), rare_n + rare_v + 1, tokens, types, ends)
    model, held = LogBilinear(vocabulary), spark.sparkContext.broadcast(vocabulary)
    share = min(1.0, WARM_TOKENS / max(1, tokens))
    text = F.substring("text", 1, WARM_TEXT).alias("text")
    warm = train.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select(text).distinct()
    # a start only: one task, whose texts are distinct and bounded in bytes whatever the corpus
    start = _averaged(warm.repartition(1).sortWithinPartitions(F.xxhash64("text")).mapInArrow(_training(held, None, EPOCHS, WARM_BYTES), BLOCKS), 1)
    learners = max(1, int(SENT * 6 * tokens / (4 * model.flat().size)))
    # a document's place is a hash of its id and text, so copies of one text go to all learners
    place = F.xxhash64("doc_id", "text") if "doc_id" in train.columns else F.xxhash64("text")
    dealt = train.select("text", place.alias("place")).repartition(learners, "place").sortWithinPartitions("place")
    texts = dealt.select("text")
    learnt = _averaged(written(texts.mapInArrow(_training(held, None if start is None else spark.sparkContext.broadcast(start)), BLOCKS), "learnt"), learners)
    if learnt is not None:
        model.load(learnt)
    return vocabulary, model


PER_TEXT = "doc_id long, mark long, held_out boolean, n_tokens long, n_known long, top double, context double"
NAMES = ("doc_id", "mark", "held_out", "n_tokens", "n_known", "top", "context")


def _score(held, rare):
    """Per text: sums over its frequent words and its context; rare words from a broadcast (rare), or left out."""

    def run(batches):
        (vocabulary, flat), reader = held.value, Texts()
        model = LogBilinear(vocabulary)
        model.load(flat)
        known = None if rare is None else rare.value
        share = np.log10(vocabulary.rare_total)
        counts = np.concatenate([vocabulary.n, [vocabulary.ends]])
        for texts, (doc, mark, out_of) in _chunks(batches, "doc_id", "mark", "held_out"):
            h, cls, sizes = reader.words(texts)
            out, end = vocabulary.symbols(h, cls), vocabulary.end
            owner = np.repeat(np.arange(len(texts)), sizes)
            is_rare = out > end
            context = model.log10(contexts(out, sizes, end), out)
            context[is_rare] -= share[out[is_rare] - end - 1]
            n = counts[np.minimum(out, end)]
            if known is not None:
                u, inverse = np.unique(h[is_rare], return_inverse=True)
                i = np.minimum(np.searchsorted(known[0], u), max(0, len(known[0]) - 1))
                found = np.where(known[0][i] == u, known[1][i], 0) if len(known[0]) else np.zeros(len(u))
                n[is_rare] = found[inverse]
                context[is_rare] += np.log10(n[is_rare] + 1)
            else:
                n[is_rare] = 0
            sums = [np.bincount(owner, weights=x, minlength=len(texts)) for x in (n > 0, np.log10(n + 1), context)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(mark, pa.int64()), pa.array(out_of, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                list(NAMES),
            )

    return run


def _rare_words(held):
    """(doc_id, mark, h, times) of the words of each text that are not frequent."""

    def run(batches):
        (vocabulary, _), reader = held.value, Texts()
        for texts, (doc, mark) in _chunks(batches, "doc_id", "mark"):
            h, cls, sizes = reader.words(texts)
            rare = vocabulary.symbols(h, cls) > vocabulary.end
            owner = np.repeat(np.arange(len(texts)), sizes)[rare]
            own = h[rare]
            order = np.lexsort((own, owner))
            own, owner = own[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])])) if len(own) else np.empty(0, np.int64)
            times = np.diff(np.append(first, len(own)))
            docs, marks = (pa.array(x, pa.int64()).take(pa.array(owner[first])) for x in (doc, mark))
            yield pa.RecordBatch.from_arrays([docs, marks, pa.array(own[first].view(np.int64)), pa.array(times, pa.int64())], ["doc_id", "mark", "h", "times"])

    return run


def lm_scores(docs: DataFrame, held_out, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); held_out(column) tells texts that are not learnt from."""
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    src = src.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False))).withColumn("mark", F.xxhash64("text"))
    train = src.where("not held_out")
    counts = written(word_counts(train), "word-counts")
    vocabulary, model = fit(train, counts)
    held = spark.sparkContext.broadcast((vocabulary, model.flat()))
    if vocabulary.types * ENTRY_BYTES <= broadcast_bytes:
        table = counts.select("h", F.col("n").alias("n")).toArrow()
        h, n = table["h"].to_numpy().view(np.uint64), table["n"].to_numpy()
        order = np.argsort(h)
        per = src.mapInArrow(_score(held, spark.sparkContext.broadcast((h[order], n[order]))), PER_TEXT)
    else:
        words = src.select("doc_id", "mark", "text").mapInArrow(_rare_words(held), "doc_id long, mark long, h long, times long")
        met = words.join(counts.select("h", "n"), "h").groupBy("doc_id", "mark", "h").agg(F.max("times").alias("times"), F.first("n").alias("n"))
        sums = met.groupBy("doc_id", "mark").agg(F.sum("times").alias("__known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("__rare"))
        sums = sums.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "__known", "__rare")
        per = src.mapInArrow(_score(held, None), PER_TEXT)
        per = per.join(sums, per["doc_id"].eqNullSafe(sums["__id"]) & (per["mark"] == sums["__mark"]), "left")
        rare = F.coalesce("__rare", F.lit(0.0))
        per = per.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("__known", F.lit(0))).alias("n_known"), (F.col("top") + rare).alias("top"), (F.col("context") + rare).alias("context"))
    return per.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("top") - F.col("n_tokens") * float(np.log10(vocabulary.tokens + vocabulary.types + 1))).alias("base_score"), F.col("context").alias("score"),
    )
