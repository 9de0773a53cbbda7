"""Queries on lengths and cuts of texts with characters above U+FFFF: every document with its e and t written as such letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.regexes import P, to_re2
from palisade.functions.spread import spread
from palisade.functions.sql import quoted
from palisade.functions.utf16 import prefix, suffix, units
from palisade.operators.extract import RAW_UNITS, SYSTEM_PHRASE, extract_prompts
from palisade.operators.findings import findings
from palisade.rules.catalogue import RULES
from palisade.rules.model import EVIDENCE_UNITS

PLAIN, WIDE = "et", "\U0001f600\U0001d495"
_CUT = 33


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", F.translate("text", PLAIN, WIDE).alias("t"))


def utf16_cuts(spark, sf_dir):
    """Lengths in units, and cuts at the front and the end of each text."""
    d = _wide(spark, sf_dir)
    return d.select("doc_id", units(F.col("t")).cast("long").alias("n_units"), prefix(F.col("t"), _CUT).alias("head"), suffix(F.col("t"), _CUT).alias("tail"))


def raw_prompts(spark, sf_dir):
    """Raw prompts of short texts: all that are longer than 50 units, however many characters these are."""
    short = F.substring("t", F.lit(1), (F.lit(20) + F.col("doc_id") % 45).cast("int"))
    files = _wide(spark, sf_dir).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), short.alias("content"))
    return extract_prompts(files, ("doc_id",)).select("doc_id", "kind", F.col("line_end").cast("long").alias("line_end"))


def evidence_cuts(spark, sf_dir):
    """Evidence of a rule on lines of such letters: its first 200 units."""
    text = F.concat(F.regexp_replace("t", r"[\s]+", " "), F.lit(" engage GODMODE"))
    p = _wide(spark, sf_dir).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit(".md").alias("ext"), F.lit(0).alias("prompt_ord"), F.lit("raw").alias("kind"), text.alias("text"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"))
    return findings(p, tuple(r for r in RULES if r.id == "JBK-010"), ("doc_id",)).select("doc_id", "rule_id", "evidence")


def queries() -> dict:
    return {"utf16_cuts": utf16_cuts, "raw_prompts": raw_prompts, "evidence_cuts": evidence_cuts}


def _units(text: str) -> str:
    return rf"(length({text}) + length(regexp_replace({text}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def _cut_sql(text: str, n: int, back: bool = False) -> str:
    """The longest part of text at its front (or end) that has at most n units."""
    part = "right" if back else "left"
    return f"{part}({text}, list_max(list_filter(range({n + 1})::int[], lambda k: {_units(f'{part}({text}, k)')} <= {n})))"


def oracle_sql() -> dict[str, str]:
    d = f"d as (select doc_id, translate(text, '{PLAIN}', '{WIDE}') as t from documents)"
    return {
        "utf16_cuts": f"with {d} select doc_id, {_units('t')}::bigint as n_units, {_cut_sql('t', _CUT)} as head, {_cut_sql('t', _CUT, True)} as tail from d",
        "raw_prompts": f"with {d}, s as (select doc_id, left(t, 20 + (doc_id % 45)::int) as c from d) select doc_id, 'raw' as kind, len(string_split(c, chr(10)))::bigint as line_end from s where {_units('c')} > {RAW_UNITS} or regexp_matches(c, {quoted(to_re2(P(SYSTEM_PHRASE)))})",
        # white space at both ends does not count as evidence; inside there are only single spaces
        "evidence_cuts": f"with {d}, s as (select doc_id, trim(regexp_replace(t, '[\\s]+', ' ', 'g') || ' engage GODMODE') as c from d) select doc_id, 'JBK-010' as rule_id, {_cut_sql('c', EVIDENCE_UNITS)} as evidence from s",
    }
