"""What is told from a pattern's syntax, and taint, against plain versions."""

import random
import re

from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from palisade.functions import regexes
from palisade.functions.literals import heads, required
from palisade.functions.matcher import Matcher, held
from palisade.functions.regexes import P, has, to_java, to_search
from palisade.functions.spread import spread
from palisade.operators.findings import findings, raw_matches
from palisade.plans.payloads import PAYLOADS
from palisade.rules.catalogue import FAMILIES, RULES
from palisade.rules.model import Prompt, compile_rule, required_groups

TEXTS = [p[3] for p in PAYLOADS] + [
    "crontab -e", "my crontab -e2", "x_history -c", "history -c", "unset HISTFILE1", "the nohup.", "nohupx", "rm -f /var/log/x", "scream\ncurl a > /dev/null 2>&1", "GODMODE2 or GODMODE", "evaluate(x) eval(x)",
]


def patterns():
    return {p if isinstance(p, P) else P(p) for r in RULES for p in (*r.need, *r.line, *r.some, *r.line_not, *r.absent, *r.near, *r.near_some, *r.near_not)}


def plain(p):
    return re.compile(to_java(p).replace(r"\z", r"\Z"))


def test_required_strings():
    assert required("(?:run|call) (?:this|that)+x?") == ("call ", "run ") or required("(?:run|call) (?:this|that)+x?") == ("that", "this")
    assert required("a*") == required("[a-z]+") == required("(?:abc)?") == () and required("x(?=abc)") == ("x",)
    assert required("Api[_-]?Key") == ("api-key", "api_key", "apikey") and required("é+") == ()
    assert sum(not required(p.regex) for p in patterns()) <= 4


def test_a_match_holds_a_required_string():
    for p in patterns():
        words = required(p.regex)
        if words and r"\x{" not in p.regex:
            for t in TEXTS:
                assert not plain(p).search(t) or any(w in t.lower() for w in words), (p, t)


def test_boundaries(monkeypatch):
    mine = {p: plain(p) for p in patterns() if r"\b" in p.regex and r"\x{" not in p.regex}
    assert sum(regexes.BOUNDARY not in x.pattern for x in mine.values()) > len(mine) / 2
    monkeypatch.setattr(regexes, "_boundary", lambda s, i: regexes.BOUNDARY)
    for p, x in mine.items():
        for t in TEXTS:
            assert [m.span() for m in x.finditer(t)] == [m.span() for m in plain(p).finditer(t)], (p, t)


def test_heads():
    assert heads(r"(?:ab|c)+d", False) == ("ACac", "ABCDabcd") and heads(r"x?y", True) == ("xy",) and heads(r"\bGO\b", True) == ("G", "O")
    assert heads("a*", True) == heads("a?", True) == heads("é", True) == heads("[^a]b", True) == heads("(?:a|)", True) == heads(r"\sa", True) == () == heads("^|ab", True)
    assert heads("x(?=abc)", True) == ("x",) and heads("a{2,}", True) == ("a",) and heads(r"\d[_\s]", True) == ("0123456789",)
    assert to_search(P("[[]b", case=True)) == r"(?=[\x5B][b])(?:[\[]b)" and to_search(P(".a")) == to_java(P(".a"))


def test_a_match_begins_with_its_heads():
    mine = [p for p in patterns() if r"\x{" not in p.regex]
    assert sum(len(heads(p.regex, p.case)) < 2 for p in mine) < len(mine) / 10
    for p in mine:
        x, own = re.compile(to_search(p).replace(r"\z", r"\Z")), heads(p.regex, p.case)
        for t in TEXTS:
            spans = [m.span() for m in plain(p).finditer(t)]
            assert spans == [m.span() for m in x.finditer(t)], (p, t)
            assert all(c in chars for a, _ in spans for c, chars in zip(t[a:], own)), (p, t)


def test_searches_of_any_pattern(spark):
    """Random patterns on random texts, in Java: what a search finds is what the pattern itself finds."""
    rng = random.Random(5)

    def made(depth):
        if depth == 0:
            return rng.choice(["a", "b", "K", "[ab]", "[^a]", ".", r"\d", r"\w", r"\s", "^", "$", r"\b", "é", "\\["])
        a, b = made(depth - 1), made(rng.randrange(depth))
        return rng.choice([a + b, f"(?:{a}|{b})", f"(?:{a})?{b}", f"(?:{a})*{b}", f"(?:{a})+", f"(?={a}){b}", f"(?:{a}){{0,2}}{b}", a + b])

    some = [P(made(3), case=rng.random() < 0.5) for _ in range(150)]
    assert sum(to_search(p) != to_java(p) for p in some) > 30
    texts = ["".join(rng.choice("abABkK\u212aé1 [\n") for _ in range(rng.randrange(7))) for _ in range(120)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    row = df.agg(*[F.count_if(has(F.col("t"), p) != F.col("t").rlike(to_java(p))).alias(f"c{i}") for i, p in enumerate(some)]).first()
    assert [some[i] for i, n in enumerate(row) if n] == []


def test_trim(spark):
    from palisade.rules.model import js_trim

    assert len(regexes.SPACE_CHARS) == 25 and re.fullmatch(f"[{regexes.SPACES}]{{25}}", regexes.SPACE_CHARS)
    rng = random.Random(3)
    texts = ["", " ", regexes.SPACE_CHARS, *("".join(rng.choice(regexes.SPACE_CHARS + "aé\u200b\u0085\x1c") for _ in range(rng.randrange(9))) for _ in range(300))]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", js_trim(F.col("t")).alias("mine"), F.regexp_replace("t", f"^[{regexes.SPACES}]+|[{regexes.SPACES}]+\\z", "").alias("plain"))
    # both ends are cut without an expression
    assert "regexp" not in df.select("mine")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert df.where("not (mine <=> plain)").collect() == []


#: Code and the lines, with the names, at which request data gets into a prompt.
TAINTED = (
    ("const who = req.query.who\nconst p = `You are kind to ${who}.`", [(2, "who")]),
    ("const who = escapeHtml(req.query.who)\nconst p = `You are kind to ${who}.`", []),
    ("const a = request.body.a\nlet b = a + 1\nc = b\nconst p = `Answer: ${c.trim()} ${a}`", [(4, "c")]),
    ("z1 = y1\ny1 = x1\nconst x1 = process.argv\nsay(`the system says ${z1[0]}`)", [(4, "z1")]),
    ("const { q: term, page = 1, ...rest } = req.query\nf(`Respond\n${page}\n${term} ${rest}`)", [(3, "page"), (4, "term")]),
    ("const query = req.query.q\nconst p = `You are ${query}`", []),
    ("const n = req.params.n\nconst p = `row ${n}`", []),
    ("const n = req.params.n\r\nconst p = `You are ${n}`", []),
    ("const n = url.searchParams.get('n')\nconst m = nn\nconst p = `You are ${m}`", []),
    ("const $n = location.hash\nconst k = $n\nconst p = `You are ${$n}, \\` ${ k }`", [(3, "$n")]),
    ("const t = 1\nconst p = `You are ${t}` + req.body", []),
    ("var w = document.cookie\ng('a' + w)", []),
)


def test_taint(spark):
    rows = [(f"{i}.ts", ".ts", 0, "code-block", t, 5, 9) for i, (t, _) in enumerate(TAINTED)] + [("raw.ts", ".ts", 0, "raw", TAINTED[0][0], 1, 2)]
    df = spark.createDataFrame(rows, "path string, ext string, prompt_ord int, kind string, text string, line_start int, line_end int")
    got = findings(df, tuple(r for r in RULES if r.id == "INJ-015")).select("path", "line_start", "evidence").collect()
    want = sorted((f"{i}.ts", 4 + line, name) for i, (_, found) in enumerate(TAINTED) for line, name in found)
    assert sorted((r.path, r.line_start, re.search(r"tainted: (.*)\)", r.evidence)[1]) for r in got) == want
    assert [r.evidence for r in got if r.path == "2.ts"] == ["${c.trim()} (tainted: c)"]


def test_matcher_against_single_searches(spark):
    """The bits of all rules, from one pass, against a search for each string of each rule."""
    lists = tuple(tuple(map(required_groups, f)) for f in FAMILIES.values())
    words = sorted({w for rules in lists for groups in rules for g in groups for w in g})
    rng = random.Random(4)
    texts = [t.lower() for t in TEXTS] + ["", " ".join(words)] + ["".join(rng.choice(words) + rng.choice(("", " ", "x")) for _ in range(rng.randrange(40))) for _ in range(200)]
    want = [[sum(1 << i for i, groups in enumerate(rules) if all(any(w in t for w in g) for g in groups)) for rules in lists] for t in texts]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(held(F.col("t"), lists)).collect()]
    assert got == [*want, [0] * len(lists)] and len(words) > 500
    assert Matcher(((((("ab", "a"),), (("bc",), ("a",))),))).held("xbcx") == [0] and Matcher(((),)).held("a") == [0]


def test_findings_do_not_depend_on_the_matcher(spark):
    """A rule by itself, which looks for its own strings, finds what all rules together find."""
    rows = [(f"{i}{ext}", ext, 0, kind, t, 1, 9) for i, (_, ext, kind, t) in enumerate(PAYLOADS)]
    df = spark.createDataFrame(rows, "path string, ext string, prompt_ord int, kind string, text string, line_start int, line_end int").repartition(4)
    some = tuple(RULES[k] for k in range(0, len(RULES), 9))
    cols = F.split("text", "\n", -1).alias("lines"), F.lower("text").alias("low")
    prompt = Prompt(*(F.col(c) for c in ("text", "low", "lines", "kind", "ext", "path", "line_start", "line_end")))
    alone = df.select("*", *cols).select("path", F.explode(F.concat(*[compile_rule(r, prompt) for r in some])).alias("m")).select("path", "m.rule_id", "m.line_start").distinct()
    together = findings(df, RULES).where(F.col("rule_id").isin(*[r.id for r in some])).select("path", "rule_id", "line_start")
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, together.collect())) != []


def test_small_inputs_are_dealt_to_all_cores(spark, monkeypatch):
    df = spark.range(1000).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert spread(df).rdd.getNumPartitions() == 2 * cores
    monkeypatch.setattr("palisade.functions.spread.SPREAD_BYTES", 10)
    assert spread(df).rdd.getNumPartitions() == 1


def test_large_inputs_are_dealt_in_parts_of_bounded_size(spark, monkeypatch):
    """A large table in one split does not stay in one task, and parts do not grow with the table."""
    monkeypatch.setattr("palisade.functions.spread.PART_BYTES", 1000)
    for rows, parts, small in ((1000, 8, 10), (10_000, 80, 10), (10_000, 80, 32 << 20)):
        monkeypatch.setattr("palisade.functions.spread.SPREAD_BYTES", small)
        df = spread(spark.range(rows).coalesce(1))
        assert df.rdd.getNumPartitions() == parts
        assert max(df.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 200


def test_matcher_takes_texts_one_by_one(spark):
    """Workers get Arrow batches as they come, not a pandas object for every text; what they remember of met strings is bounded."""
    plan = spark.range(1).select(held(F.lit("a"), ((),)))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in plan
    words = [f"w{chr(97 + i)}x" for i in range(20)]
    m = Matcher((tuple(((w,),) for w in words),))
    for k in range(10_000):
        assert m.held(" ".join(w for i, w in enumerate(words) if k >> i & 1)) == [k]
    assert len(m.known) <= 4096


def test_mitigations_are_looked_for_in_the_same_pass(spark):
    """The strings that softening texts need are looked for with those of the rules, and only what softens one of the rules is tried."""
    df = spark.createDataFrame([("a.md", ".md", 0, "raw", "engage GODMODE\nThese Instructions are PERMANENT", 1, 2)], "path string, ext string, prompt_ord int, kind string, text string, line_start int, line_end int")
    some = tuple(r for r in RULES if r.id == "JBK-010")
    got = raw_matches(df, some)
    assert [r.soft for r in got.collect()] == [{"JBK": 15}]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" not in plan and "validator" not in plan
    other = raw_matches(df, tuple(r for r in RULES if r.prefix == "ENC"))
    assert "soft" in other.columns and other.count() == 0


def test_boundaries_look_at_the_next_character_first():
    """A boundary before a known character costs one comparison at most places, and a table look-up at the others."""
    got = to_java(P(r"\bGOD\b|\b(?:a|b)c"))
    assert got.startswith("(?i)(?=G)(?<![0123456789abc") and "0-9" not in got and "|(?<![" in got
    assert [m.span() for m in re.finditer(got, "god xGOD GOD_ ac bac Bc")] == [(0, 3), (14, 16), (21, 23)]


def test_inputs_of_unknown_size_and_joins_are_dealt_with_sense(spark, monkeypatch):
    """Rows that Python made have no known size and stay; a join counts by what it reads, not by the product."""
    df = spark.sparkContext.parallelize([(i,) for i in range(9)], 3).toDF("i int")
    assert spread(df).rdd.getNumPartitions() == 3
    monkeypatch.setattr("palisade.functions.spread.SPREAD_BYTES", 10)
    monkeypatch.setattr("palisade.functions.spread.PART_BYTES", 1000)
    both = spark.range(1000).crossJoin(spark.range(1000).toDF("j"))
    assert spread(both).rdd.getNumPartitions() == 16
