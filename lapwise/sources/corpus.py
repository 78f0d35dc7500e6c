"""SQL corpora: one file per query beside the datasets of a suite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lapwise.operators.ordering import natural_order


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``id`` and ``sql`` of all ``*.sql`` files of a folder."""
    return (
        spark.read.option("pathGlobFilter", "*.sql")
        .text(folder, wholetext=True)
        .select(
            F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), r"\.sql\z", "").alias("id"),
            F.col("value").alias("sql"),
        )
    )


def corpus_queries(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """The queries in natural order, as the suite runner takes them; none is an error."""
    rows = read_corpus(spark, folder).orderBy(*natural_order("id")).collect()
    if not rows:
        raise ValueError(f"No SQL query files were found at {folder}")
    return [(row["id"], row["sql"]) for row in rows]


def write_corpus(queries: DataFrame, folder: str) -> None:
    """Store texts (``id``, ``sql``) as a corpus table with one folder per query."""
    texts = queries.select(F.col("id").alias("query"), F.col("sql").alias("value"))
    texts.write.mode("overwrite").partitionBy("query").text(folder)


def read_written_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """A corpus table as ``id`` and ``sql``."""
    texts = spark.read.text(folder, wholetext=True)
    return texts.select(F.col("query").cast("string").alias("id"), F.regexp_replace("value", r"\n\z", "").alias("sql"))
