"""Comparison of two runs of the same queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lapwise.functions.numbers import at_least, ratio, to_fixed
from lapwise.functions.text import pad_start
from lapwise.operators.iterations import failed
from lapwise.operators.median import exact_median
from lapwise.operators.ordering import natural_order

# Factors from which a change is highlighted, and report marks.
QUERY_THRESHOLD = 1.5
TOTAL_THRESHOLD = 1.1
MARKS = {("faster", True): "✅", ("faster", False): "✔", ("slower", True): "❌", ("slower", False): "✖"}
LABEL_WIDTH = 8
TIME_WIDTH = 4


def change_factor(previous: Column, new: Column) -> Column:
    """Larger over smaller in the direction of change; equal times count as slower by 1."""
    return F.when(new < previous, ratio(previous, new)).otherwise(ratio(new, previous))


def direction(previous: Column, new: Column) -> Column:
    return F.when(new < previous, "faster").otherwise("slower")


def outcome(previous_failed: Column, new_failed: Column, previous: Column, new: Column) -> Column:
    return (
        F.when(previous_failed & new_failed, "still_failing")
        .when(previous_failed, "recovered")
        .when(new_failed, "newly_failed")
        .otherwise(direction(previous, new))
    )


_SIDE_MEASURES = {"p50": "p50", "representative": "time", "failed": "failed", "average_tasks": "tasks"}


def join_runs(previous: DataFrame, new: DataFrame, keys: Sequence[str] = ("dataset", "id")) -> DataFrame:
    """Queries of two summaries side by side; those in one run only are left out.

    Both sides are already one row per query, so the join never meets a hot key.
    """
    keys = list(keys)
    side = lambda df, prefix: df.select(
        *keys, *[F.col(m).alias(f"{prefix}_{short}") for m, short in _SIDE_MEASURES.items()]
    )
    return side(previous, "prev").join(side(new, "new"), keys)


def pivot_runs(
    summary: DataFrame, previous_engine: str | Column, new_engine: str | Column,
    keys: Sequence[str] = ("dataset", "id"),
) -> DataFrame:
    """The same for two runs of one summary, which is then computed once instead of once per side."""
    name = lambda engine: F.lit(engine) if isinstance(engine, str) else engine
    prev, new = F.col("engine") == name(previous_engine), F.col("engine") == name(new_engine)
    measures = [
        F.max(F.when(side, F.col(m))).alias(f"{prefix}_{short}")
        for prefix, side in (("prev", prev), ("new", new))
        for m, short in _SIDE_MEASURES.items()
    ]
    paired = summary.where(prev | new).groupBy(*keys).agg(*measures)
    return paired.where(F.col("prev_failed").isNotNull() & F.col("new_failed").isNotNull())


def compare_queries(paired: DataFrame, keys: Sequence[str] = ("dataset", "id")) -> DataFrame:
    """Judge every query that both runs have."""
    prev, now = F.col("prev_p50"), F.col("new_p50")
    timed = ~F.col("prev_failed") & ~F.col("new_failed")
    factor = F.when(timed, change_factor(prev, now))
    return paired.select(
        *keys,
        "prev_p50",
        "new_p50",
        "prev_time",
        "new_time",
        "prev_tasks",
        "new_tasks",
        outcome(F.col("prev_failed"), F.col("new_failed"), prev, now).alias("outcome"),
        factor.alias("factor"),
        F.coalesce(at_least(factor, QUERY_THRESHOLD), F.lit(False)).alias("highlighted"),
    )


def task_change(df: DataFrame, previous: str = "prev_tasks", new: str = "new_tasks") -> DataFrame:
    """Add direction, absolute difference and percentage of a change in task counts."""
    prev, now = F.col(previous), F.col(new)
    kind = (
        F.when(prev.isNull() | now.isNull(), F.lit(None))
        .when(prev == now, "no change")
        .when(now < prev, "fewer")
        .otherwise("more")
    )
    delta = F.abs(now - prev)
    return df.select(
        "*",
        kind.alias("task_direction"),
        delta.alias("task_delta"),
        F.when((prev != 0) & (prev != now), ratio(delta, prev) * 100).alias("task_percent"),
    )


def run_totals(compared: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Total times and tasks over the queries that both runs finished."""
    timed = F.col("prev_time").isNotNull() & F.col("new_time").isNotNull()
    tasked = timed & F.col("prev_tasks").isNotNull() & F.col("new_tasks").isNotNull()
    total = lambda column, when, zero: F.coalesce(F.sum(F.when(when, F.col(column))), F.lit(zero))
    totals = compared.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("compared"),
        F.count_if(timed).alias("timed"),
        total("prev_time", timed, 0).cast("bigint").alias("prev_time"),
        total("new_time", timed, 0).cast("bigint").alias("new_time"),
        # Rounded, as a sum of doubles depends on their order in its last digits.
        F.round(total("prev_tasks", tasked, 0.0), 6).alias("prev_tasks"),
        F.round(total("new_tasks", tasked, 0.0), 6).alias("new_tasks"),
    )
    prev, now = F.col("prev_time"), F.col("new_time")
    factor = change_factor(prev, now)
    return totals.select(
        "*",
        factor.alias("factor"),
        direction(prev, now).alias("direction"),
        at_least(factor, TOTAL_THRESHOLD).alias("highlighted"),
    )


def pooled_q_errors(
    iterations: DataFrame, compared: DataFrame, keys: Sequence[str] = ("dataset", "engine")
) -> DataFrame:
    """Median q-errors of a run, pooled over all iterations of the queries timed on both sides.

    A pool spans a whole run; its median is found between bounds, never by gathering the pool.
    """
    timed = compared.where(F.col("prev_time").isNotNull() & F.col("new_time").isNotNull())
    pooled = iterations.join(timed.select("dataset", "id"), ["dataset", "id"], "left_semi")
    values = pooled.select(*keys, F.stack(
        F.lit(2),
        F.lit("p50"), F.col("stats_q_error_p50"),
        F.lit("p95"), F.col("stats_q_error_p95"),
    ).alias("statistic", "value"))
    return exact_median(values, [*keys, "statistic"], "value", "q_error")


def ordered_set_check(base: DataFrame, head: DataFrame) -> DataFrame:
    """Per dataset, whether both sides list the same ids at the same positions.

    Inputs are ``dataset, position, id``.  Lists are compared position by
    position, so no list is ever assembled in one row.
    """
    both = base.select("dataset", "position", F.col("id").alias("base_id")).join(
        head.select("dataset", "position", F.col("id").alias("head_id")), ["dataset", "position"], "full_outer"
    )
    counted = both.groupBy("dataset").agg(
        F.count("base_id").alias("base_count"),
        F.count("head_id").alias("head_count"),
        F.count_if(~F.col("base_id").eqNullSafe(F.col("head_id"))).alias("differences"),
    )
    verdict = (
        F.when(F.col("base_count") == 0, "base_empty")
        .when(F.col("head_count") == 0, "head_empty")
        .when(F.col("differences") > 0, "differ")
        .otherwise("same")
    )
    return counted.select("*", verdict.alias("verdict"))


# --- report lines -----------------------------------------------------------
# The texts of all lines below.


def _mark(kind: Column, highlighted: Column) -> Column:
    mark = F.lit(None).cast("string")
    for (name, strong), text in MARKS.items():
        mark = F.when((kind == name) & (highlighted == F.lit(strong)), text).otherwise(mark)
    return mark


def task_text(previous: Column, new: Column) -> Column:
    """``prev=6.0, new=5.0, diff=1.0 fewer (16.7%)``."""
    delta = F.abs(new - previous)
    word = F.when(new < previous, " fewer (").otherwise(" more (")
    percent = to_fixed(ratio(delta, previous) * 100, 1)
    diff = (
        F.when(new == previous, "no change")
        .when(previous == 0, F.concat(to_fixed(new, 1), F.lit(" more")))
        .otherwise(F.concat(to_fixed(delta, 1), word, percent, F.lit("%)")))
    )
    return F.concat(F.lit("prev="), to_fixed(previous, 1), F.lit(", new="), to_fixed(new, 1), F.lit(", diff="), diff)


def query_line() -> Column:
    """Report line of one compared query."""
    time = lambda column: pad_start(F.col(column).cast("string"), TIME_WIDTH)
    timed = F.concat(
        pad_start(F.col("id"), LABEL_WIDTH), F.lit(": prev="), time("prev_p50"), F.lit(" ms, new="), time("new_p50"),
        F.lit(" ms, diff="), to_fixed(F.col("factor"), 2), F.lit(" "), F.col("outcome"), F.lit(" "),
        _mark(F.col("outcome"), F.col("highlighted")),
    )
    tasks = F.when(
        F.col("prev_tasks").isNotNull() & F.col("new_tasks").isNotNull(),
        F.concat(F.lit(", tasks: "), task_text(F.col("prev_tasks"), F.col("new_tasks"))),
    ).otherwise("")
    return (
        F.when(F.col("outcome") == "recovered", F.concat("id", F.lit(": Previously failed, but now succeeded 🟠")))
        .when(F.col("outcome") == "newly_failed", F.concat("id", F.lit(": Previously succeeded, but now failed ❌")))
        .when(F.col("outcome") == "still_failing", F.concat("id", F.lit(": Previously failed, and now also failed ❌")))
        .otherwise(F.concat(timed, tasks))
    )


def q_error_lines(q_errors: DataFrame, pairs: DataFrame) -> DataFrame:
    """One line per dataset and statistic for which either side has a value."""
    values = q_errors.join(pairs, "dataset").groupBy("dataset", "statistic").agg(
        F.max(F.when(F.col("engine") == F.col("prev_engine"), F.col("q_error"))).alias("prev"),
        F.max(F.when(F.col("engine") == F.col("new_engine"), F.col("q_error"))).alias("new"),
    )
    shown = lambda column: F.coalesce(F.concat(to_fixed(F.col(column), 2), F.lit("x")), F.lit("n/a"))
    label = pad_start(F.concat(F.lit("QERR "), F.upper("statistic")), LABEL_WIDTH)
    return values.where(F.col("prev").isNotNull() | F.col("new").isNotNull()).select(
        "dataset",
        F.when(F.col("statistic") == "p50", 2).otherwise(3).alias("section"),
        F.concat(label, F.lit(": prev="), shown("prev"), F.lit(", new="), shown("new")).alias("line"),
    )


def comparison_lines(
    pairs: DataFrame, compared: DataFrame, totals: DataFrame, q_errors: DataFrame
) -> DataFrame:
    """All report lines of all datasets with their sort keys.

    ``pairs`` names the two runs of a dataset (``dataset, prev_engine,
    new_engine``).  Lines carry (section, query number, id) as sort keys, so
    ordering them is left to the reader or to one global sort.
    """
    header = pairs.select(
        "dataset",
        F.lit(0).alias("section"),
        F.lit(None).cast("string").alias("id"),
        F.concat(
            F.lit("=== Comparing "), "dataset", F.lit(" results '"), "prev_engine", F.lit("' [prev] with '"),
            "new_engine", F.lit("' [new] ==="),
        ).alias("line"),
    )
    queries = compared.select("dataset", F.lit(1).alias("section"), "id", query_line().alias("line"))
    errors = q_error_lines(q_errors, pairs).select(
        "dataset", "section", F.lit(None).cast("string").alias("id"), "line"
    )
    every = pairs.select("dataset").join(totals, "dataset", "left").na.fill(
        0, ["prev_time", "new_time", "prev_tasks", "new_tasks"]
    ).select(
        "dataset",
        "prev_time",
        "new_time",
        "prev_tasks",
        "new_tasks",
        F.coalesce("factor", F.lit(float("nan"))).alias("factor"),
        F.coalesce("direction", F.lit("slower")).alias("direction"),
        F.coalesce("highlighted", F.lit(False)).alias("highlighted"),
    )
    tasks = every.select(
        "dataset", F.lit(4).alias("section"), F.lit(None).cast("string").alias("id"),
        F.concat(
            F.lit(pad("TASKS")), F.lit(": "), task_text(F.col("prev_tasks"), F.col("new_tasks")),
            F.lit(" (sum of per-query averages)"),
        ).alias("line"),
    )
    total = every.select(
        "dataset", F.lit(5).alias("section"), F.lit(None).cast("string").alias("id"),
        F.concat(
            F.lit(pad("TOTAL")), F.lit(": prev="), F.col("prev_time").cast("string"), F.lit(" ms, new="),
            F.col("new_time").cast("string"), F.lit(" ms, diff="), to_fixed(F.col("factor"), 2), F.lit(" "),
            "direction", F.lit(" "), _mark(F.col("direction"), F.col("highlighted")),
        ).alias("line"),
    )
    return header.unionByName(queries).unionByName(errors).unionByName(tasks).unionByName(total)


def pad(label: str) -> str:
    return label.rjust(LABEL_WIDTH)


def line_order() -> list[Column]:
    """Sort keys of report lines."""
    return [F.col("dataset"), F.col("section"), *natural_order("id")]
