"""Row numbers for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    slices: Sequence[str | Column],
    order: Sequence[str | Column],
    name: str = "position",
    start: int = 1,
) -> DataFrame:
    """``row_number`` per ``keys`` in the order ``slices + order``.

    A group is never ordered as a whole: the rows of a slice are numbered on
    their own and shifted by the size of the slices before it, which a count
    combined before the shuffle yields.  Slices are ordered parts of a group
    that the caller knows to be small, such as a minute of a run.  Without any
    the groups themselves are: they are ordered where they lie, and rows dealt
    by some of the keys are not shuffled again.
    """
    shift = F.lit(1 - start).cast("bigint")
    if not slices:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - shift)
    names = [f"_slice{i}" for i in range(len(slices))]
    cuts = [F.col(s) if isinstance(s, str) else s for s in slices]
    rows = df.select("*", *[c.alias(n) for c, n in zip(cuts, names)])
    group = [*keys, *names]
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*[F.col(g).alias(f"_of{g}") for g in group], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_of{g}")) for g in group])
    within = Window.partitionBy(*group).orderBy(*order)
    return (
        rows.join(offsets, same)
        .withColumn(name, F.row_number().over(within) + F.col("_offset") - shift)
        .drop(*names, "_offset", *[f"_of{g}" for g in group])
    )


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], limit: int, name: str = "rank"
) -> DataFrame:
    """The first ``limit`` rows of every group, with their rank.

    For limits up to ``spark.sql.optimizer.windowGroupLimitThreshold`` (1,000
    as a rule) Spark cuts every group to ``limit`` rows in each task before the
    shuffle, so a hot group stays small.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= F.lit(limit))
