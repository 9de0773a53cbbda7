"""Sharding, periodic runs and the divergence audit against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import divergence, periodic_runs, queries, sharding
from palisade.llm.recompression import Grammar
from tests.llm import brute_new as brute
from tests.llm.test_operators import ODD, srt

CLASH = ("row", "runs", "text_crc32", "shard", "slot", "size", "key", "copies", "n", "term", "total", "mark", "best", "n_words", "collapsed")


@pytest.fixture(scope="module")
def rows(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    hot = [(None, "")] * 60 + [(7, "same")] * 50 + [(None, "é " * 40)] * 3 + [(8, "a b c " * 30 + "x y " * 20 + "b " * 15), (9, "Ä\x85Ä \xa0 " * 30)]
    return [tuple(r) for r in d.collect()] + ODD + hot


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH})
    return df.repartition(3)


def test_jump_moves_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2)
    assert sharding.jump(keys[:300], 1).tolist() == [0] * 300
    for n in (1, 2, 7, 16, 1000):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert a.tolist() == [brute.jump(int(k), n) for k in keys.tolist()]
        assert ((a == b) | (b == n)).all() and abs((b == n).mean() - 1 / (n + 1)) < 0.03


@pytest.mark.parametrize("sizes", [(20_000, 10_000), (3, 7)])  # many buckets, and copies in chunks
def test_placements(docs, rows, monkeypatch, sizes):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", sizes[0])
    monkeypatch.setattr(sharding, "CHUNK", sizes[1])
    got = sharding.placements(docs, 16).select("key", "size", "text_crc32", "shard", "slot", "grown_shard").collect()
    assert srt(got) == srt(brute.placements(rows, 16))


def test_placements_do_not_depend_on_partitions(docs):
    a, b = (srt(sharding.placements(docs.repartition(n), 5).collect()) for n in (1, 7))
    assert a == b


def test_write_shards(spark, docs, tmp_path):
    path = str(tmp_path / "out")
    plain = docs.drop("shard")
    sharding.write_shards(plain, path, 6, files=2)
    back = spark.read.parquet(path)
    assert srt(back.select(*plain.columns).collect()) == srt(plain.collect())
    assert all(r.shard == brute.placements([(r.doc_id, r.text)], 6)[0][3] for r in back.collect())
    with pytest.raises(ValueError):
        sharding.write_shards(docs, path, 6)


def test_grammar_extensions():
    """Common extensions both ways by the grammar against stepping word by word."""
    rng = random.Random(3)
    for k in (1, 2, 4, 50):
        w = [rng.randrange(k) for _ in range(300)] + list(range(k)) * 20 + [0] * 150
        s = np.array([900, *w, 901])
        g = Grammar(s)
        a = np.array([rng.randrange(1, len(s) - 2) for _ in range(500)])
        b = np.array([rng.randrange(x + 1, len(s) - 1) for x in a.tolist()])

        def plain(i, j, step):
            n = 0
            while s[i + n * step] == s[j + n * step]:
                n += 1
            return n

        assert g.forward(a, b).tolist() == [plain(i, j, 1) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert g.backward(a, b).tolist() == [plain(i, j, -1) for i, j in zip(a.tolist(), b.tolist(), strict=True)]


@pytest.mark.parametrize("table", [1 << 15, 20])  # 20: grids in slices, as for very long texts
def test_runs(monkeypatch, table):
    monkeypatch.setattr(periodic_runs, "TABLE_WORDS", table)
    monkeypatch.setattr(periodic_runs, "SLICE", 50 if table == 20 else 1 << 20)
    periodic_runs._table.cache_clear()
    rng = random.Random(5)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.choice([0, 1, 11, 12, 13, 40, 150]), rng.choice([1, 2, 3, 30])
            w = [rng.randrange(k) for _ in range(n)]
            if n > 12 and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(2, 9)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(np.array(w, np.int64))
        least = rng.choice([2, 12, 12, 30])
        assert [list(map(tuple, r.tolist())) for r in periodic_runs.runs_of(docs, least)] == [brute.runs(w.tolist(), least) for w in docs]
    periodic_runs._table.cache_clear()


def test_run_digests(docs, rows):
    short = [(d, t) for d, t in rows if len(t or "") < 8000]
    got = periodic_runs.run_digests(docs.where("length(coalesce(text, '')) < 8000"))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = srt(got.collect())
    assert got == srt(brute.run_digest(*r) for r in short) and sum(r[1] > 0 for r in got) > 10


def test_runs_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "GROUP_WORDS", 100)
    text = "one two three " * 20_000 + " ".join(f"w{i}" for i in range(50_000))
    out = periodic_runs.periodic_runs(spark.createDataFrame([(1, text), (2, "a"), (3, None)], "id long, text string")).orderBy("row.id").collect()
    assert [[tuple(x) for x in r.runs] for r in out] == [[(0, 60_000, 3)], [], []] and [r.n_words for r in out] == [110_000, 1, 0]
    assert out[0].collapsed.startswith("one two three w0 w1 ")


@pytest.mark.parametrize("blocks", [{}, {"block_terms": 7, "tile": 3}])
def test_divergence(spark, data, blocks):
    d = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("lang", "source", "text").collect()]
    d += [(None, None, None), ("xx", "one", "rare"), ("xx", None, ""), ("xx", "Two", "éé É"), (None, "src0", "word WORD\x85ä " * 30)] + [("yy", f"s{k % 3}", "tie tied x" + "y" * (k % 2)) for k in range(40)]
    df = spark.createDataFrame(d, "lang string, source string, text string").withColumns({c: F.lit(1) for c in CLASH}).repartition(3)
    got = divergence.divergence(df, **blocks)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert srt(got.collect()) == srt(brute.divergence(d))


def test_held_counts_are_handed_on(spark, data, monkeypatch):
    df = spark.read.parquet(f"{data}/documents.parquet")
    a = srt(divergence.term_counts(df).collect())
    monkeypatch.setattr(divergence, "HELD", 50)
    assert srt(divergence.term_counts(df).collect()) == a


def test_shares_are_exact_for_large_counts():
    count, total = np.array([0, 1, 9 * 10**14, 123_456_789_012]), 9 * 10**14 + 77
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * (c + 2) // total for c in count.tolist()]


def test_reordering_shortens_runs():
    counts = np.random.default_rng(2).integers(0, 3, (4, 500))
    order = divergence.reordered(counts)
    many = lambda c: sum(len(divergence.run_lengths(r, 600)[0]) for r in c)
    assert sorted(order.tolist()) == list(range(500)) and many(counts[:, order]) < many(counts) / 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, extra int")
    assert sharding.placements(none, 16).count() == 0
    assert periodic_runs.run_digests(none).count() == 0
    assert divergence.divergence(none).count() == 0


def test_registered():
    assert {"op11_sharding", "op12_periodic_runs", "op13_divergence"} <= set(queries.queries()) & set(queries.oracle_sql())
