"""Statistics of measured iterations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lapwise.functions.numbers import round_half_up
from lapwise.operators.median import median_bounds, median_within
from lapwise.operators.numbering import number_rows

QUERY_KEY = ("dataset", "engine", "id")


def failed(error: str | Column = "error") -> Column:
    """An iteration failed if it carries a non-empty error text."""
    column = F.col(error) if isinstance(error, str) else error
    return F.coalesce(column, F.lit("")) != ""


def successful_iterations(iterations: DataFrame) -> DataFrame:
    return iterations.where(~failed())


def query_summary(iterations: DataFrame, keys: Sequence[str] = QUERY_KEY) -> DataFrame:
    """One row per query of a run: counts, median, representative time and average tasks.

    ``p50`` skips failed iterations and is 0 without any success;
    ``representative`` is null as soon as one iteration failed.  One pass yields
    all measures but the median, which takes a second one between the bounds
    that the first has found (see ``exact_median``).
    """
    keys = list(keys)
    ok = ~F.col("_failed")
    timed = F.when(ok, F.col("elapsed").cast("double"))
    rows = iterations.select(*keys, "elapsed", "tasks", failed().alias("_failed")).withColumn("_v", timed)
    measures = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("iterations"),
        F.count_if(ok).alias("successes"),
        F.bool_or("_failed").alias("failed"),
        _mean_tasks(ok).alias("average_tasks"),
        *median_bounds(F.col("_v")),
    )
    medians = median_within(rows.select(*keys, "_v"), measures, keys, "_median")
    named = medians.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_median")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    summary = measures.join(named, same, "left")
    median = F.col("_median")
    p50 = round_half_up(F.coalesce(median, F.lit(0.0))).cast("bigint")
    return summary.select(
        *keys,
        "iterations",
        "successes",
        "failed",
        p50.alias("p50"),
        F.when(~F.col("failed"), p50).alias("representative"),
        "average_tasks",
    )


def _mean_tasks(ok: Column) -> Column:
    return F.sum(F.when(ok, F.col("tasks"))).cast("double") / F.nullif(F.count_if(ok), F.lit(0))


def average_tasks(iterations: DataFrame, keys: Sequence[str] = QUERY_KEY) -> DataFrame:
    """Mean task count of successful iterations, null without any."""
    return iterations.groupBy(*keys).agg(_mean_tasks(~failed()).alias("average_tasks"))


def first_errors(iterations: DataFrame, keys: Sequence[str] = QUERY_KEY, order: str = "iteration") -> DataFrame:
    """First non-empty error text of every query, null if it never failed."""
    # Texts are compared among failed iterations only; all others are just counted.
    first = F.min(F.struct(F.col(order).alias("_order"), F.col("error")))
    errors = iterations.where(failed()).groupBy(*keys).agg(first["error"].alias("first_error"))
    return iterations.select(*keys).distinct().join(errors, [*keys], "left")


def sum_tasks(iterations: DataFrame, keys: Sequence[str] = ("dataset", "engine")) -> DataFrame:
    """Tasks of error-free iterations of the ``q*`` queries, per run.

    Unlike the other statistics this one takes an empty error text for an error.
    """
    queries = iterations.where(F.col("id").startswith("q"))
    clean = F.when(F.col("error").isNull(), F.col("tasks"))
    return queries.groupBy(*keys).agg(F.coalesce(F.sum(clean), F.lit(0)).cast("bigint").alias("tasks"))


def iteration_index(records: DataFrame, keys: Sequence[str] = QUERY_KEY) -> DataFrame:
    """Number the measured iterations of every query from 0 in the order they started."""
    return number_rows(
        records,
        keys=keys,
        slices=[F.date_trunc("minute", F.col("started_at"))],
        order=["started_at", "seq"],
        name="iteration",
        start=0,
    )
