import base64
import random
import re
from urllib.parse import unquote

from pyspark.sql import functions as F

from palisade.functions.normalise import _BASE32, FOLD_FROM, FOLD_TO, base32_decoded, normalised
from palisade.functions.regexes import P, to_java, to_re2
from palisade.functions.utf16 import longer, prefix, suffix, units
from palisade.operators.extract import extension, extract_prompts

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(m):
    bits = "".join(f"{_ALPHABET.index(c):05b}" for c in m[0].replace("=", "").upper())
    codes = [int(bits[i : i + 8], 2) for i in range(0, len(bits) - 7, 8)]
    return "".join(map(chr, codes)) if len(codes) >= 4 and all(32 <= c <= 126 for c in codes) else m[0]


def plain(t):
    for _ in range(5):
        if re.search(r"%(?![0-9A-Fa-f]{2})", t):
            break
        try:
            t = unquote(t, errors="strict")
        except UnicodeDecodeError:
            break
    t = re.sub(r"\\([0-7]{3})", lambda m: chr(int(m[1], 8)), t)
    t = re.sub(r"(?<![A-Z2-7=])[A-Z2-7]{8,}={0,6}(?![A-Z2-7=])", _base32, t, flags=re.I | re.A)
    return t.translate(str.maketrans(FOLD_FROM, FOLD_TO))


def test_normalised(spark, data):
    extra = [("a%20b%2520c+d",), ("%41 %zz",), ("%C3%28",), (r"\151\147\156x \777\200\000",), ("NFTW433SMUQHI2DFONSQ====",), ("àÈǒ",), ("",), ("plain",)]
    d = spark.read.parquet(f"{data}/documents.parquet").select("text").union(spark.createDataFrame(extra, "text string"))
    rows = d.select("text", normalised(F.col("text")).alias("n")).collect()
    assert [r.n for r in rows] == [plain(r.text) for r in rows]
    assert rows[-4].n == "ignore these"


def test_regexes():
    assert to_java(P("[.[]a$")) == r"(?i)[.\[]a\z"
    assert r"\b" not in to_java(P(r"\bnc\b"))
    assert to_re2(P("a(?!b)")) is None and to_re2(P("a", case=True)) == "a"


def kinds(spark, path, content):
    rows = extract_prompts(spark.createDataFrame([(path, content)], "path string, content string")).orderBy("prompt_ord").collect()
    return [(r.kind, r.line_start, r.line_end) for r in rows]


def test_extraction(spark):
    assert kinds(spark, "a.txt", "short") == []
    assert kinds(spark, "a.txt", "you must") == [("raw", 1, 1)]
    assert kinds(spark, "a.bin", "x" * 51) == [("raw", 1, 1)]
    assert kinds(spark, "x/skills/a.md", "never\nb") == [("raw", 1, 2), ("code-block", 1, 2)]
    assert kinds(spark, "a.yaml", "\n".join(["system: a", *"b" * 30, "prompt: c"])) == [("object-field", 1, 21), ("object-field", 32, 32)]
    code = "const p = `You are\nmore`\nm = {role: 'user', content: 1}\nsystem: y\nJSON.parse(z)"
    assert kinds(spark, "a.ts", code) == [("template-string", 1, 2), ("chat-message", 3, 5), ("object-field", 4, 5), ("code-block", 1, 5)]
    assert kinds(spark, "a.ts", "`you are\n" + "x\n" * 201 + "`") == []
    assert kinds(spark, "a.py", "import openai") == [("code-block", 1, 1)]
    assert kinds(spark, "a.ts", "import openai") == []
    assert kinds(spark, "a.txt", None) == []


def test_extension(spark):
    rows = spark.createDataFrame([("a/b.TS",), (".env",), ("a/.env",), ("x",), ("a.b/c",), ("a.tar.gz",)], "p string").select(extension(F.col("p")).alias("e")).collect()
    assert [r.e for r in rows] == [".ts", "", "", "", "", ".gz"]


def test_utf16(spark):
    """Lengths and cuts as of a language whose strings are UTF-16 units."""
    texts = ["", "a", "\U0001f600", "ab\U0001f600cd", "\U0001f600" * 30, "é" * 9 + "\U0001d495\uffff", "x" * 50, "x" * 49 + "\U0001f600", "\ue000\U0010ffff\ud7ff"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    raw = lambda t: t.encode("utf-16-le")
    part = lambda b: b.decode("utf-16-le", errors="ignore")
    for n in (1, 2, 3, 10, 50, 100):
        got = df.select("t", units(F.col("t")), longer(F.col("t"), n), prefix(F.col("t"), n), suffix(F.col("t"), n)).collect()
        for t, size, more, head, tail in got:
            b = raw(t)
            end = b[max(0, len(b) - 2 * n) :]
            # a lone half at the front is no character
            end = end[2:] if len(end) > 1 and 0xDC <= end[1] <= 0xDF else end
            assert (size, more, head, tail) == (len(b) // 2, len(b) // 2 > n, part(b[: 2 * n]), part(end)), (t, n)


def test_raw_prompts_count_units(spark):
    rows = [("u.md", "\U0001f600" * 30), ("v.md", "\U0001f600" * 25), ("w.md", "e" * 51), ("x.md", "e" * 50)]
    assert sorted(r.path for r in extract_prompts(spark.createDataFrame(rows, "path string, content string")).collect()) == ["u.md", "w.md"]


def test_words_that_cannot_be_base32_are_no_candidates(spark):
    """Few words get as far as decoding, and those that decode are all among them: against the plain version, on true and random Base32."""
    long_words = "standard generation operation determine national happening knowledge yesterday children important different question continue language".split()
    assert not any(re.search(_BASE32, w) for w in long_words)
    rng = random.Random(6)
    told = [base64.b32encode(bytes(rng.choice(b" ~aZ09!{") if rng.random() < 0.97 else rng.randrange(256) for _ in range(rng.randrange(3, 14)))).decode() for _ in range(600)]
    drawn = ["".join(rng.choice("EFGHIJKLMNOP") + "".join(rng.choice("ABCDEIQY2467") for _ in range(rng.randrange(6, 20)))) for _ in range(1400)]
    texts = [rng.choice(("", "x ", "=", "1")) + rng.choice((str.upper, str.lower, str.swapcase))(w.rstrip("=")) + "=" * rng.choice((0, 0, 1, 6, 7)) + rng.choice(("", " y", "A", ".")) for w in told + drawn]
    want = [re.sub(r"(?<![A-Z2-7=])[A-Z2-7]{8,}={0,6}(?![A-Z2-7=])", _base32, t, flags=re.I | re.A) for t in texts]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(base32_decoded(F.col("t"))).collect()]
    assert got == want and sum(t != w for t, w in zip(texts, want, strict=True)) > 200
