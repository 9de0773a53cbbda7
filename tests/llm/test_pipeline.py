import collections
import pathlib
import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from palisade.llm import quality
from tests.llm import brute


def test_stages_against_brute_force(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    state, outs = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        state = stage(spark, state, data)
        state.write.parquet(str(tmp_path / str(i)))
        state = spark.read.parquet(str(tmp_path / str(i)))
        outs.append(state)
        if i < 4:
            assert state.columns == names
            assert not state.where(F.length("text") != F.col("n_chars")).count()
    pairs = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    start = pairs(docs)
    verdict = brute.ratios([t for _, t in start], quality.BUCKETS, quality.SMOOTH, quality.THRESHOLD)
    first = [x for x, (_, kept) in zip(start, verdict, strict=True) if kept]
    assert pairs(outs[0]) == first
    second = [(d, k) for d, _, _, k in brute.line_dedup(first)]
    assert pairs(outs[1]) == sorted(second)
    third = [(d, t) for (d, t), (_, _, c) in zip(second, brute.simhash(second), strict=True) if d == c]
    assert pairs(outs[2]) == sorted(third)
    fourth = pairs(outs[3])
    assert [d for d, _ in fourth] == [d for d, _ in sorted(third)] and not any(brute.base_spans(t) for _, t in fourth)
    assert fourth == sorted((d, brute.redacted(t)) for d, t in third)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = collections.Counter()
    for r in outs[4].collect():
        tokens[r.doc_id] += r.length
    assert dict(tokens) == {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in fourth}
    assert corpus_pipeline.run(spark, data).count() == outs[4].count()
    assert np.isclose(outs[4].agg(F.sum("length")).first()[0], sum(tokens.values()))


ODD = "doc_id long, text string, lang string, source string, n_chars long, row int, kept boolean, rank int, n int, mark long, __text string"


def odd_rows():
    prose = " ".join(f"word{i % 37} of line {i}" for i in range(40))
    texts = [None, "", " \n\t", "short", prose, prose, prose + " password = abcdef1", "x" * 100_000, prose + "\na line that is in every text\n" + prose[:50]]
    ids = [None, 1, 1, 2, 3, 3, None, 4, 5]
    return [(i, t, "en", "s", None if t is None else len(t), 1, True, 2, 3, 4, "t") for i, t in zip(ids, texts, strict=True)]


def test_stages_take_odd_rows(spark):
    """Null texts and ids, repeated rows, long texts, names like our own: every stage keeps the columns, and what it keeps it keeps whole."""
    docs = spark.createDataFrame(odd_rows(), ODD)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.schema.names == docs.columns and out.count() <= docs.count()
        assert not out.where("text is not null and n_chars <> length(text)").count()
    packed = corpus_pipeline.best_fit_packing(spark, docs, "")
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.line_dedup(spark, docs, "").count() == corpus_pipeline.secret_scans(spark, docs, "").count() == docs.count()


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_near_dedup_keeps_one_row_of_a_group(spark):
    """Repeated and null ids: a row stays for its own group only."""
    a, b, c = ("alpha beta gamma delta", "one two three four five", "red green blue")
    rows = [(1, a), (1, b), (0, b), (2, c), (2, c), (2, c.upper()), (None, "w x y z"), (None, "W x y z"), (None, a)]
    got = [r.text for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sorted(t.lower() for t in got) == sorted([a, b, c, "w x y z"])


def helper_names():
    """Every name that the operators and the pipeline give a column."""
    root = pathlib.Path(corpus_pipeline.__file__).parent
    text = "".join(p.read_text() for p in [root / "corpus_pipeline.py", *(root / "palisade/llm").glob("*.py")])
    found = re.findall(r'(?:alias|withColumn|withColumnRenamed|col)\("(\w+)"', text) + re.findall(r'"(__\w+)"', text)
    by_case = {n.lower(): n for n in found}  # Spark does not tell names by case
    return sorted(n for k, n in by_case.items() if k not in ("doc_id", "text", "n_chars"))


def test_no_name_breaks_or_changes_a_row(spark, data):
    """Columns named like every helper, and names with a dot: what a stage keeps has all columns as they were."""
    names = helper_names()
    assert {"__quality", "__model", "__spans", "__rules", "row", "mark", "id", "new", "kept", "fp"} <= set(names)
    base = spark.read.parquet(f"{data}/documents.parquet")
    extra = {n: F.concat(F.lit(n + " "), F.col("doc_id").cast("string")) for n in [*names, "a.b"]}
    docs = base.select("doc_id", "text", "n_chars", *(v.alias(n) for n, v in extra.items()))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out, plain = stage(spark, docs, data), stage(spark, base.select("doc_id", "text", "n_chars"), data)
        assert out.columns == docs.columns, name
        wrong = [F.col(f"`{n}`") != v for n, v in extra.items()]
        flagged = out.select("doc_id", "text", "n_chars", F.greatest(*(w.cast("int") for w in wrong)).alias("bad"))
        rows = flagged.collect()
        assert sorted(tuple(r)[:3] for r in rows) == sorted(map(tuple, plain.collect())) and all(r[3] == 0 for r in rows), name
    packed = corpus_pipeline.best_fit_packing(spark, docs, data)
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == base.count()


def test_near_dedup_picks_a_row_by_all_columns(spark):
    rows = [(1, "same text", "b"), (1, "same text", "a"), (1, "same text", "c")]
    got = [corpus_pipeline.near_dedup(spark, spark.createDataFrame(r, "doc_id long, text string, x string").repartition(3), "").collect() for r in (rows, rows[::-1])]
    assert len(got[0]) == 1 and got[0] == got[1]
