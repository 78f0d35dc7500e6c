"""Whole rows beside the columns an operator works with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Outer white space of a text: the word gaps of the contracts that split on it.
GAP = r"[\x20\x09-\x0D]+"


def text_of(column: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column, gap: str = GAP) -> Column:
    """The parts of a text between gaps; none for an empty text."""
    return F.array_remove(F.split(text, gap), "")


def packed(docs: DataFrame) -> DataFrame:
    """The rows as one struct ``row``, so that no column of theirs clashes with a computed one."""
    return docs.select(F.struct("*").alias("row"))


def unpacked(rows: DataFrame) -> DataFrame:
    """The original columns of packed rows."""
    return rows.select("row.*")


def identity(id_column: Column, text: Column) -> Column:
    """What tells rows apart: the id with a hash of the text, as ids may be repeated or null."""
    return F.struct(id_column.alias("id"), F.xxhash64(text).alias("text_hash"))


def hash_below(id_column: Column, share: Column) -> Column:
    """Whether the hash of an id falls into the lowest ``share`` of all hashes; a sample that is the same on every run."""
    return F.xxhash64(id_column).cast("double") < F.lit(-(2.0**63)) + share * F.lit(2.0**64)
