"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.let import let
from palisade.sinks.tables import shared_dir, written

#: One word: anything but ASCII white space (Java and Python read it alike).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Rows of a key from which on its partner is broadcast, and how many keys are broadcast at most.
HOT_ROWS, MOST_HOT = 100_000, 1_000_000


def join_uneven(rows: DataFrame, per_key: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with per_key, which has one row a key and in column `n` how many of rows have it; rows are `total` at most.

    Keys of more than `hot` rows are broadcast, so their rows stay where they are. As hot is at least total / MOST_HOT, these
    are MOST_HOT keys at most, whatever the table; any other key has under a millionth of the rows, or HOT_ROWS."""
    hot = max(HOT_ROWS, total // MOST_HOT)
    per_key = per_key.withColumnRenamed(key, "__key")
    large = per_key.where(F.col("n") > hot).drop("n")
    met = rows.join(F.broadcast(large), F.col(key) == F.col("__key"), "left")
    rest = met.where("__key is null").select(*rows.columns).join(per_key.drop("n"), F.col(key) == F.col("__key"))
    return met.where("__key is not null").unionByName(rest).drop("__key")


def whole_text(df: DataFrame, text: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


__all__ = ["HOT_ROWS", "MOST_HOT", "SPACE", "WORD", "ascii_lower", "join_uneven", "let", "shared_dir", "whole_text", "written"]
