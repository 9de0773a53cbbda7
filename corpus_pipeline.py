"""The corpus pipeline: documents are filtered, cleaned, de-duplicated, redacted and packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last
return the columns of documents; where a stage changes a text, n_chars follows. Rows with a null
doc_id or a repeated doc_id go through every stage; near-dedup keeps one row of each group.

A null text counts as empty: quality rules reject it, as they do every text of fewer than ten words, so later stages
meet it only where they are called by themselves, and then it stays null. Very long texts are taken whole. Repeated rows and ties are judged alike, but for
near-dedup, which of rows tied for a group's smallest doc_id keeps the least by a hash of all columns. Empty tables
give empty tables. Further columns may have any names: a stage works on the doc_id, the text and the whole row as one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.line_dedup import drop_repeated_lines
from palisade.llm.packing import pack, pieces
from palisade.llm.quality import quality
from palisade.llm.secrets import find_secrets, redacted
from palisade.llm.simhash import representatives, text_mark


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the whole row beside them, so that no name of the table meets one of an operator."""
    return docs.select(docs["doc_id"], docs["text"], F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))


def _rows(df: DataFrame, docs: DataFrame, changed=None, text=None) -> DataFrame:
    """The rows of docs that df has in `row`, with another text where `changed` holds."""
    out = {c: F.col("row")[c] for c in docs.columns}
    if text is not None:
        df = df.select("row", F.when(changed, text).alias("new"))
        out["text"] = F.coalesce(F.col("new"), out["text"])
        if "n_chars" in out:
            out["n_chars"] = F.when(F.col("new").isNotNull(), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return df.select(*(value.alias(c) for c, value in out.items()))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the n-gram ratio reject go."""
    return _rows(quality(_packed(docs)).where("__quality.kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share go, but for the last document's."""
    return _rows(drop_repeated_lines(docs), docs, F.col("n_dropped") > 0, F.col("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that of the smallest doc_id, of its texts the least by hash, and of their rows the least by a hash of all columns."""
    kept = representatives(docs.select("doc_id", "text")).select(F.col("doc_id").alias("id"), F.col("mark").alias("of"), "n")
    marked = _packed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_mark().alias("mark"), "row")
    met = marked.join(kept, marked["doc_id"].eqNullSafe(kept["id"]) & (marked["mark"] == kept["of"])).select("id", "mark", "n", "row")
    told = F.xxhash64(*(F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"))
    many = met.where("n > 1").groupBy("id", "mark").agg(F.min_by("row", told).alias("row"))
    return _rows(met.where("n = 1").select("row").unionByName(many.select("row")), docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    out = find_secrets(_packed(docs))
    return _rows(out, docs, F.size("__spans") > 0, redacted(F.col("text"), F.col("__spans")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row for each piece of a document."""
    import public_tokenizers

    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: Fingerprint components and packing can't be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    from palisade.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
