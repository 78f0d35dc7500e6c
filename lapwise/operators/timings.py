"""Phase timings of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _exact(name: str) -> Column:
    return F.when(F.col("side") == name, F.col("duration_ms").cast("decimal(18,3)"))


def pair_timings(timings: DataFrame, sums: bool = False) -> DataFrame:
    """The i-th dataset of a job with its i-th base and head duration, 0 where a side has none.

    Both sides come from one grouping on (job, position) instead of a join of
    the table with itself.  With ``sums`` each pair also has what ``phase_totals``
    adds up: the exact ``base_sum`` and ``head_sum`` and the number of ``timings``.
    """
    side = lambda name: F.coalesce(F.max(F.when(F.col("side") == name, F.col("duration_ms"))), F.lit(0.0))
    parts = [F.sum(_exact("base")).alias("base_sum"), F.sum(_exact("head")).alias("head_sum"), F.count(F.lit(1)).alias("timings")]
    first = F.coalesce(
        F.max(F.when(F.col("side") == "base", F.col("dataset"))), F.max("dataset")
    )
    return timings.groupBy("job_id", "pos").agg(
        first.alias("dataset"), side("base").alias("base_ms"), side("head").alias("head_ms"), *(parts if sums else [])
    )


def phase_totals(timings: DataFrame, *more: Column, paired: bool = False) -> DataFrame:
    """Total benchmark durations of a job per side, and ``more`` aggregates of the same rows.

    ``paired`` rows are those of ``pair_timings`` with sums.
    """
    part = (lambda name: F.col(f"{name}_sum")) if paired else _exact
    total = lambda name: F.coalesce(F.sum(part(name)), F.lit(0)).cast("double")
    phases = F.sum("timings") if paired else F.count(F.lit(1))
    return timings.groupBy("job_id").agg(
        total("base").alias("base_ms"), total("head").alias("head_ms"), phases.alias("phases"), *more
    )
