"""Toxicity: a factorization machine over hashed terms.

Terms are words and their beginnings, each at the levels of rate it reaches in the text, hashed into a
fixed number of buckets. The terms most associated with the label are kept, and a factorization
machine learns a weight for each and, through factor vectors, the weight of each pair: an insult with
a mention of a group can score above what both score alone.

The model is fitted on at most about SAMPLE labelled documents (by hash of doc_id, never by order), one row each, in one task
whose input is bounded by SAMPLE * KEPT; its size is fixed by KEPT and FACTORS. Scoring is one narrow pass.

Null and empty texts score the model's bias. Very long texts are read whole. Repeated rows score alike. Of several labels of a
doc_id the largest counts, of several texts the one of least hash. Of terms equally associated those of smaller number
are kept. Rows whose label or doc_id is
null do not train. Extra columns are ignored. Without a usable label, or with labels of one kind only, every score is 0. An
empty table gives no rows.
"""

from __future__ import annotations

import functools
import pickle
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import written

#: At most about so many labelled rows fit the model.
SAMPLE = 12_000
BUCKETS, KEPT, LEAST_ROWS, FACTORS = 1 << 18, 4096, 6, 4
PREFIXES = (3, 4, 5, 6, 7)
#: A term's level is the number of these rates, per word of the text, that it reaches.
RATES = (0.0, 1 / 400, 1 / 120, 1 / 40)
EPOCHS, STEP, DECAY, POSITIVE = 12, 0.1, 1e-4, 4.0
THRESHOLD = 0.7
_STRIP = ".,;:!?\"'()[]|*$%&#"
CACHE_WORDS = 1 << 19


@functools.lru_cache(maxsize=CACHE_WORDS)
def word_buckets(word: str) -> tuple[int, ...]:
    """The buckets of a word and of its beginnings."""
    w = word.lower().strip(_STRIP)
    if not w:
        return ()
    terms = {f"={w}"} | {f"^{w[:n]}" for n in PREFIXES if len(w) > n}
    return tuple(zlib.crc32(t.encode()) % BUCKETS for t in terms)


def text_terms(text: str | None, buckets=word_buckets) -> list[int]:
    """bucket * levels + level for every level that a bucket's rate reaches."""
    words = (text or "").split()
    count: Counter[int] = Counter()
    for w, n in Counter(words).items():
        for b in buckets(w):
            count[b] += n
    total, k = max(1, len(words)), len(RATES)
    return [b * k + i for b, n in count.items() for i, rate in enumerate(RATES) if n > rate * total]


def _sample_terms(batches):
    for b in batches:
        terms = [text_terms(t) for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["y"], pa.array(terms, pa.list_(pa.int32()))], ["y", "terms"])


class Machine:
    """score(x) = bias + sum of w + sum over pairs of <v, v'>, over the kept terms present."""

    def __init__(self, terms: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.terms, self.bias, self.w, self.v = terms, bias, w, v

    def logit(self, at: np.ndarray) -> float:
        s = self.v[at].sum(axis=0)
        return float(self.bias + self.w[at].sum() + 0.5 * ((s * s).sum() - (self.v[at] ** 2).sum()))


def fit(rows: list[np.ndarray], y: np.ndarray, terms: np.ndarray, seed: int = 1) -> Machine:
    """AdaGrad on the logistic loss; rows hold positions in terms."""
    rng = np.random.default_rng(seed)
    n, d = len(rows), len(terms)
    rate = float(np.clip(y.mean() if n else 0.0, 1e-4, 1 - 1e-4))
    bias, w, v = np.log(rate / (1 - rate)), np.zeros(d + 1), rng.normal(0, 0.01, (d + 1, FACTORS))
    v[d] = 0
    gb, gw, gv = 1e-8, np.full(d + 1, 1e-2), np.full((d + 1, FACTORS), 1e-2)
    weight = np.where(y > 0, POSITIVE, 1.0)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for i in range(0, n, 64):
            part = order[i : i + 64]
            width = max(1, max(len(rows[j]) for j in part))
            at = np.full((len(part), width), d)
            for r, j in enumerate(part):
                at[r, : len(rows[j])] = rows[j]
            here = (at < d)[..., None]
            vv = v[at] * here
            s = vv.sum(axis=1)
            z = bias + (w[at] * here[..., 0]).sum(axis=1) + 0.5 * ((s * s).sum(axis=1) - (vv**2).sum(axis=(1, 2)))
            g = weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            dw, dv = np.zeros(d + 1), np.zeros((d + 1, FACTORS))
            np.add.at(dw, at, g[:, None] * here[..., 0])
            np.add.at(dv, at, g[:, None, None] * (s[:, None, :] - vv) * here)
            dw += DECAY * w
            dv += DECAY * v
            gw += dw * dw
            gv += dv * dv
            gb += g.sum() ** 2
            w -= STEP * dw / np.sqrt(gw)
            v -= STEP * dv / np.sqrt(gv)
            bias -= STEP * g.sum() / np.sqrt(gb)
            w[d] = v[d] = 0
    return Machine(terms, float(bias), w[:d], v[:d])


def train(docs: DataFrame, labels: DataFrame, label: str, usable, sample: int = SAMPLE) -> Machine | None:
    """The machine for labels[label] (0 or 1) from rows whose doc_id meets usable(column)."""
    spark = docs.sparkSession
    known = labels.where(usable(labels["doc_id"]) & labels["doc_id"].isNotNull() & labels[label].isin(0, 1)).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    total = known.count()
    if not total:
        return None
    share = min(1.0, sample / total)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # at most `sample` rows of 12 bytes: bounded by that parameter, so broadcast
    text = F.col("text").cast("string")
    met = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = met.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("y", "text")
    terms = written(texts.mapInArrow(_sample_terms, "y int, terms array<int>"), "toxic-terms")
    size = terms.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    if not size["n"] or not size["p"] or size["p"] == size["n"]:
        return None
    rate = size["p"] / size["n"]
    by_term = terms.select("y", F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.sum("y").alias("p")).where(F.col("n") >= LEAST_ROWS)
    z = F.abs(F.col("p") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    kept = np.array(sorted(r["t"] for r in by_term.orderBy(z.desc(), "t").limit(KEPT).collect()), np.int64)

    def places(batches):
        """Only what was kept goes on to the one task."""
        for b in batches:
            rows = []
            for terms in b["terms"].to_pylist():
                t = np.array(sorted(terms), np.int64)
                i = np.minimum(np.searchsorted(kept, t), len(kept) - 1)
                rows.append(i[kept[i] == t])
            yield pa.RecordBatch.from_arrays([b["y"], pa.array(rows, pa.list_(pa.int32()))], ["y", "terms"])

    def learn(batches):
        rows, y = [], []
        for b in batches:
            rows += [np.array(x, np.int64) for x in b["terms"].to_pylist()]
            y += b["y"].to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_state(fit(rows, np.array(y, float), kept)))])], ["model"])

    if not len(kept):
        return None
    # the sample's size is a parameter, so one task is enough; its order is fixed for equal results
    ordered = terms.mapInArrow(places, "y int, terms array<int>").repartition(1).sortWithinPartitions(F.xxhash64("terms"), "y")
    return Machine(*pickle.loads(ordered.mapInArrow(learn, "model binary").first()["model"]))


def _state(m: Machine):
    return m.terms, m.bias, m.w, m.v


def score(docs: DataFrame, model: Machine | None) -> DataFrame:
    """(doc_id, score)."""
    held = docs.sparkSession.sparkContext.broadcast(None if model is None else _state(model))

    def run(batches):
        machine = None if held.value is None else Machine(*held.value)
        if machine is not None:
            wanted = set((machine.terms // len(RATES)).tolist())

            @functools.lru_cache(maxsize=CACHE_WORDS)
            def buckets(word):
                return tuple(b for b in word_buckets.__wrapped__(word) if b in wanted)

        for b in batches:
            out = []
            for text in b["text"].to_pylist():
                if machine is None:
                    out.append(0.0)
                    continue
                t = np.array(sorted(text_terms(text, buckets)), np.int64)
                i = np.minimum(np.searchsorted(machine.terms, t), len(machine.terms) - 1)
                out.append(float(1 / (1 + np.exp(-np.clip(machine.logit(i[machine.terms[i] == t]), -30, 30)))))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """(doc_id, held_out, score, predicted); held_out(column) tells the doc_ids that never train."""
    model = train(docs, labels, "toxic", lambda c: ~held_out(c))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
