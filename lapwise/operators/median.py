"""Exact medians for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# Share of a group on either side of its middle that is counted value by value.  The quantile sketch that
# bounds it is five times as accurate, and exact for small groups.
_MARGIN = 2.5e-4
_SKETCH_ACCURACY = 20_000
_BOUNDS = ("_n", "_nan", "_low", "_high")


def exact_median(rows: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Median per group (mean of the two middle values), ignoring nulls; NaN is the largest value.

    Two passes, the same for every group.  The first takes a mergeable quantile
    sketch of bounded size, combined before the shuffle: it bounds the middle of
    the group.  The second counts the rows below, and how often each value
    within the bounds occurs, and picks the middle ranks from these counts.
    """
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    bounds = rows.groupBy(*keys).agg(*median_bounds(F.col("_v")))
    return median_within(rows, bounds, keys, name)


def _ordered(v: Column) -> Column:
    """NaN as Infinity: comparisons of both are plain, and they are told apart by their number."""
    return F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v)


def median_bounds(v: Column) -> list[Column]:
    """Aggregates of the first pass over a value that is null where it does not count."""
    sketch = F.percentile_approx(_ordered(v), [0.5 - _MARGIN, 0.5 + _MARGIN], _SKETCH_ACCURACY)
    return [
        F.count(v).alias("_n"),
        F.count_if(F.isnan(v)).alias("_nan"),
        F.get(sketch, F.lit(0)).alias("_low"),
        F.get(sketch, F.lit(1)).alias("_high"),
    ]


def _same(keys: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def median_within(rows: DataFrame, bounds: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The second pass over ``rows`` (keys and ``_v``) with the aggregates of the first."""
    keys = list(keys)
    limits = bounds.where("_n > 0").select(*[F.col(k).alias(f"_key_{k}") for k in keys], *_BOUNDS)
    w = _ordered(F.col("_v"))
    # Rows below the bounds are one value, so that they are counted with the others.
    placed = F.when(w >= F.col("_low"), w)
    counted = (
        rows.join(limits, _same(keys, "_key_"))
        .where(F.col("_v").isNotNull() & (w <= F.col("_high")))
        .groupBy(*keys, *_BOUNDS, placed.alias("_w"))
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    upto = Window.partitionBy(*keys).orderBy(F.col("_w").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_end", F.sum("_count").over(upto))
    lower, upper = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    hit = lambda rank: (F.col("_end") - F.col("_count") <= rank) & (rank < F.col("_end"))
    at = lambda rank: F.max(F.when(hit(rank), _found(F.col("_w"), rank)))
    middle = ranked.groupBy(*keys).agg(at(lower).alias("_lower"), at(upper).alias("_upper"))
    outside = F.col("_lower").isNull() | F.col("_upper").isNull()
    mean = F.when(F.col("_lower") == F.col("_upper"), F.col("_lower")).otherwise(0.5 * F.col("_lower") + 0.5 * F.col("_upper"))
    failure = F.raise_error(F.lit("The bounds of a median do not hold")).cast("double")
    return middle.select(*keys, F.when(outside, failure).otherwise(mean).alias(name))


def _found(w: Column, rank: Column) -> Column:
    """The value at a rank; the last ``_nan`` of a group are NaN."""
    return F.when(rank >= F.col("_n") - F.col("_nan"), F.lit(float("nan"))).otherwise(w)
