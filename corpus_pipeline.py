"""From raw documents to token ids: quality rules, line dedup, near-duplicates, decontamination, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result to the shared folder and reads it again as the next stage's input.
All stages but the last return the columns of their input, with ``n_chars``
(where there is one) following the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lapwise.llm.bpe import encode
from lapwise.llm.decontamination import decontaminate
from lapwise.llm.line_dedup import line_dedup
from lapwise.llm.near_copies import one_of_each
from lapwise.llm.quality_rules import quality_rules
from lapwise.session import cut
from lapwise.sources.tables import read_table

VOCABULARY = "byte_bpe_50k.json"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, keep_rows=True).where("kept").select("row.*")


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that an earlier place has; those left without a line go."""
    deduped = line_dedup(docs).where("n_lines = 0 OR n_removed < n_lines")
    changed = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        length = F.length("kept").cast(kind)
        changed["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(F.col("row.n_chars"))
    return deduped.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash of five-word shingles, similarity of 0.8 or more."""
    return one_of_each(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark")).where(F.size("hits") == 0).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and whether they decode to the text."""
    encoded = encode(docs, public_tokenizers.path(VOCABULARY))
    return encoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", new_lines),
    ("simhash", distinct_documents),
    ("decontamination", clean_documents),
    ("bpe", token_ids),
]

# Expectation-maximisation, XXH64 and BPE are not expressible; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
