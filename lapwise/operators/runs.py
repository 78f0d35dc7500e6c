"""Runs in the order they were stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapwise.operators.numbering import number_rows

_DAY_SECONDS = 86_400


def previous_run_pairs(runs: DataFrame) -> DataFrame:
    """Every run of a dataset with the one stored just before it, null for the first.

    Runs (``dataset, engine, stored_at``) are numbered in storing order and
    joined to their predecessor by number, which spreads a dataset with many
    runs; a ``lag`` would order them in one task.
    """
    numbered = number_rows(
        runs.select("dataset", "engine", "stored_at").distinct(),
        keys=["dataset"],
        slices=[F.floor(F.col("stored_at") / _DAY_SECONDS)],
        order=["stored_at", "engine"],
        name="run",
    )
    before = numbered.select("dataset", (F.col("run") + 1).alias("run"), F.col("engine").alias("previous_engine"))
    return numbered.join(before, ["dataset", "run"], "left").select(
        "dataset", "engine", "stored_at", "run", "previous_engine"
    )
