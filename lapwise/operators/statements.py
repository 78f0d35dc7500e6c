"""Folding of paged statement results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


# First row count of an output operator in a plan text.
OUTPUT_ROWS = r"(?is)Output.*?([0-9]+)\s+rows"


def plan_output_rows(plan):
    """Row count that a plan text reports, null without one."""
    return F.nullif(F.regexp_extract(plan, OUTPUT_ROWS, 1), F.lit("")).try_cast("bigint")


def fold_statements(pages: DataFrame) -> DataFrame:
    """One row per statement: last plan, row count, last elapsed time.

    A plan page that reports a row count sets it; data pages after it add
    theirs.  Rows counted before the last such page are therefore lost.  The
    fold needs no page order: the last reporting page comes from a maximum and
    the rows behind it are summed after joining that page number back.  Both
    aggregations combine map-side, and the join side is one row per statement.
    """
    reported = plan_output_rows(F.col("plan"))
    read = pages.select("*", reported.alias("_reported"))
    if "error" not in pages.columns:
        read = read.withColumn("error", F.lit(None).cast("string"))
    latest = lambda value: F.max_by(value, F.when(F.col(value).isNotNull(), F.col("page")))
    folded = read.groupBy("statement_id").agg(
        latest("plan").alias("plan"),
        latest("_reported").alias("_set"),
        latest("elapsed_ms").alias("_elapsed"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page"))).alias("error"),
    )
    # Page numbers alone fit a hash aggregation, unlike the texts above.
    reporting = F.max(F.when(F.col("_reported").isNotNull(), F.col("page")))
    marks = read.groupBy("statement_id").agg(F.coalesce(reporting, F.lit(-1)).alias("_from"))
    added = (
        pages.where(F.col("plan").isNull() & F.col("data_rows").isNotNull())
        .select("statement_id", "page", "data_rows")
        .join(marks, "statement_id")
        .where(F.col("page") > F.col("_from"))
        .groupBy("statement_id")
        .agg(F.sum("data_rows").alias("_added"))
    )
    rows = F.coalesce("_set", F.lit(0)) + F.coalesce("_added", F.lit(0))
    return folded.join(added, "statement_id", "left").select(
        "statement_id",
        F.coalesce("plan", F.lit("")).alias("plan"),
        rows.cast("bigint").alias("row_count"),
        F.coalesce("_elapsed", F.lit(0)).cast("bigint").alias("elapsed_ms"),
        "error",
    )
