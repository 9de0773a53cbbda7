"""Quality rules: fixed heuristics, then a hashed n-gram log-likelihood ratio.

Only built-in column functions. Words and pairs of neighbouring words are hashed into buckets, a range of
buckets for each order; for each order two multinomials are counted over the whole corpus: one from documents that meet a strict trust
predicate, one from all. A document's verdict is the sum of the log ratios of its words and pairs, divided by
its number of words, against a fixed threshold. The trust predicate needs no more than counts of words, symbols
and lines, so the first pass is narrow: a count for each bucket comes out of each task. The number of buckets is a
parameter, so nothing that is gathered grows with the corpus beyond it.

Null and empty texts have no words: every count is 0, base_failed is true and kept false. A text of one word has no
pair. Very long texts are measured whole. Repeated rows are judged each on its own, and each counts. An empty table gives
no rows. Without any trusted document no ratio is told and all that meet the base rules are kept. Extra columns are kept;
the result's names are prefixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import SPACE, WORD, let, whole_text

WINDOW = 5
#: Log ratio a word below which a document goes.
THRESHOLD = -0.5
#: Buckets of an order; the longest n-gram.
BUCKETS, ORDERS = 1 << 16, 2
#: Added to each bucket's count.
SMOOTH = 2.0
SYMBOLS = "[#*$%&|<>]"


def _covered(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes in order."""

    def repeated(s):
        same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        starts = F.sort_array(F.transform(F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct((p + WINDOW).cast("int").alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).cast("int").alias("n"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)
        ),
    )


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def base_columns(text: Column, words: Column) -> list[Column]:
    """words must be a name bound by let(), as it is used inside lambdas."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    windows = F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    return [
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _covered(windows).cast("long").alias("n_repeat_words"),
    ]


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def trusted(text: Column, n_words: Column) -> Column:
    """Texts that stand for clean ones: of some length, nearly no symbols, no line twice."""
    symbols = F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return (n_words >= 30) & (1000 * symbols <= F.length(text)) & let(lines, lambda x: F.size(x) == F.size(F.array_distinct(x)))


def ngram_buckets(words: Column, buckets: int) -> Column:
    """Buckets of all words, then of all pairs of neighbours; words must be a name bound by let()."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: (F.lit(buckets) + F.pmod(F.xxhash64(F.get(words, i), w), F.lit(buckets))).cast("int"))
    return F.concat(one, two)


def ratio_model(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with the array of log ratios, trusted against all, of each order's buckets.

    Without trusted documents every ratio is 0."""
    text = whole_text(docs)
    counted = let(words_of(text), lambda w: F.struct(trusted(text, F.size(w)).cast("long").alias("good"), ngram_buckets(w, buckets).alias("grams")))
    grams = docs.select(counted.alias("c")).select(F.col("c.good").alias("good"), F.explode("c.grams").alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("n"), F.sum("good").alias("g"))
    every = docs.sparkSession.range(ORDERS * buckets).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("g"))
    counts = counts.union(every).groupBy("b").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    total = lambda c: [F.sum(F.when(F.floor(F.col("b") / buckets) == k, F.col(c)).otherwise(0)) for k in range(ORDERS)]
    row = counts.agg(F.array(*total("n")).alias("N"), F.array(*total("g")).alias("G"), F.sort_array(F.collect_list(F.struct("b", "n", "g"))).alias("a"))

    def ratio(x):
        k = F.floor(x["b"] / buckets).cast("int")
        own = F.log((x["g"] + SMOOTH) / (F.get("G", k) + SMOOTH * buckets)) - F.log((x["n"] + SMOOTH) / (F.get("N", k) + SMOOTH * buckets))
        return F.when(F.get("G", k) > 0, own).otherwise(F.lit(0.0))

    return row.select(F.transform("a", ratio).alias("llr"))


def quality(docs: DataFrame, corpus: DataFrame | None = None, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """docs with a struct column __quality: base counts, base_failed, llr (log ratio a word) and kept.

    corpus: what the multinomials are counted over, docs itself if None. The whole verdict is one
    expression whose parts are named by let(), so no optimiser rule can repeat them inside a lambda."""
    model = ratio_model(docs if corpus is None else corpus, buckets).scalar()
    text = whole_text(docs)

    def ratio(w):
        total = F.aggregate(ngram_buckets(w, buckets), F.lit(0.0), lambda acc, b: acc + F.get(F.col("__model"), b))
        return F.when(F.size(w) > 0, F.round(total / F.size(w), 6)).otherwise(F.lit(0.0))

    measured = let(words_of(text), lambda w: F.struct(*base_columns(text, w), ratio(w).alias("llr")))

    def verdict(m):
        kept = ~base_failed(m) & (m["llr"] >= threshold)
        return F.struct(*[m[c].alias(c) for c in BASE], base_failed(m).alias("base_failed"), m["llr"].alias("llr"), kept.alias("kept"))

    return docs.withColumn("__model", model).withColumn("__quality", let(measured, verdict)).drop("__model")
