"""Medians, summaries, comparison rules and report lines."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from lapwise.fixtures import Fixtures
from lapwise.functions.numbers import at_least, ratio, round_half_up, to_fixed
from lapwise.operators import comparison as c
from lapwise.operators.iterations import first_errors, query_summary, sum_tasks
from lapwise.operators.median import exact_median
from lapwise.operators.numbering import number_rows
from lapwise.operators.ordering import natural_order, natural_positions
from lapwise.operators.timings import pair_timings, phase_totals
from lapwise.plans.compare import compare_pairs

SCHEMA = (
    "dataset string, engine string, id string, iteration bigint, elapsed double, row_count bigint, tasks bigint, "
    "stats_q_error_p50 double, stats_q_error_p95 double, error string"
)


def iterations(spark, *records):
    """(engine, id, elapsed, tasks[, error]) records of one dataset."""
    data = [("tpch/sf1", r[0], r[1], i, float(r[2]), 1, r[3], None, None, r[4] if len(r) > 4 else None)
            for i, r in enumerate(records)]
    return spark.createDataFrame(data, SCHEMA)


def pairs(spark):
    return spark.createDataFrame([("tpch/sf1", "base", "head")], "dataset string, prev_engine string, new_engine string")


def lines(spark, *records):
    result = compare_pairs(iterations(spark, *records), pairs(spark))
    return [r["line"] for r in result.lines().orderBy(*c.line_order()).collect()]


def test_report_of_one_query(spark):
    assert lines(spark, ("base", "q1", 100, 1), ("head", "q1", 90, 1)) == [
        "=== Comparing tpch/sf1 results 'base' [prev] with 'head' [new] ===",
        "      q1: prev= 100 ms, new=  90 ms, diff=1.11 faster ✔, tasks: prev=1.0, new=1.0, diff=no change",
        "   TASKS: prev=1.0, new=1.0, diff=no change (sum of per-query averages)",
        "   TOTAL: prev=100 ms, new=90 ms, diff=1.11 faster ✅",
    ]


def test_task_averages(spark):
    text = lines(
        spark, ("base", "q1", 100, 6), ("base", "q1", 100, 6), ("base", "q2", 100, 10),
        ("head", "q1", 100, 4), ("head", "q1", 100, 6), ("head", "q2", 100, 10),
    )
    assert "tasks: prev=6.0, new=5.0, diff=1.0 fewer (16.7%)" in text[1]
    assert text[-2] == "   TASKS: prev=16.0, new=15.0, diff=1.0 fewer (6.3%) (sum of per-query averages)"


@pytest.mark.parametrize(
    "prev, new, query_mark, total_mark",
    [(100, 149, "✖", "❌"), (100, 150, "❌", "❌"), (150, 100, "✅", "✅"), (100, 109, "✖", "✖"), (100, 110, "✖", "❌"),
     (100, 100, "✖", "✖")],
)
def test_thresholds(spark, prev, new, query_mark, total_mark):
    text = lines(spark, ("base", "q1", prev, 1), ("head", "q1", new, 1))
    assert f" {query_mark}," in text[1]
    assert text[-1].endswith(total_mark)


def test_failures_and_totals_scope(spark):
    text = lines(
        spark, ("base", "q1", 10, 1, "lost"), ("head", "q1", 10, 1), ("base", "q2", 10, 1), ("head", "q2", 10, 1, "lost"),
        ("base", "q3", 10, 1, "lost"), ("head", "q3", 10, 1, "lost"), ("base", "q4", 30, 2), ("head", "q4", 20, 2, ""),
        ("head", "q5", 99, 9),
    )
    assert text[1] == "q1: Previously failed, but now succeeded 🟠"
    assert text[2] == "q2: Previously succeeded, but now failed ❌"
    assert text[3] == "q3: Previously failed, and now also failed ❌"
    assert text[4].startswith("      q4: prev=  30 ms, new=  20 ms, diff=1.50 faster ✅")
    assert text[-1] == "   TOTAL: prev=30 ms, new=20 ms, diff=1.50 faster ✅"


def test_nothing_in_common_gives_undefined_total(spark):
    text = lines(spark, ("base", "q1", 10, 1), ("head", "q2", 10, 1))
    assert text[-1] == "   TOTAL: prev=0 ms, new=0 ms, diff=NaN slower ✖"


def test_summary_rules(spark):
    data = iterations(
        spark, ("e", "even", 1, 4), ("e", "even", 2, 6), ("e", "even", 4, 0, "x"), ("e", "none", 5, 3, "x"),
        ("e", "blank", 2.5, 1, ""), ("e", "half", 2, 1), ("e", "half", 3, 1),
    )
    found = {r["id"]: r for r in query_summary(data).collect()}
    assert (found["even"]["p50"], found["even"]["representative"], found["even"]["average_tasks"]) == (2, None, 5.0)
    assert (found["none"]["p50"], found["none"]["representative"], found["none"]["average_tasks"]) == (0, None, None)
    assert (found["blank"]["p50"], found["blank"]["representative"]) == (3, 3)  # 2.5 rounds up
    assert found["half"]["p50"] == 3
    # an empty error text counts as an error only for the task sum
    queries = data.withColumn("id", F.concat(F.lit("q"), "id"))
    assert rows(sum_tasks(queries), "tasks") == [(12,)]
    assert dict(rows(first_errors(data), "id", "first_error"))["even"] == "x"


def _numpy_order_median(values):
    """Mean of the middle values with NaN last, as numpy and Spark's percentile order them."""
    ordered = sorted(values, key=lambda v: (math.isnan(v), v))
    lower, upper = ordered[(len(ordered) - 1) // 2], ordered[len(ordered) // 2]
    return lower if lower == upper else 0.5 * lower + 0.5 * upper


def test_median_of_any_group(spark):
    rng = random.Random(3)
    inf, nan = math.inf, math.nan
    values = {
        "spread": [rng.uniform(-1e6, 1e6) for _ in range(400)],
        "tiny": [rng.uniform(1e-12, 2e-12) for _ in range(301)],
        "gap": [1.0] * 50 + [1e9] * 50,
        "same": [7.25] * 77,
        "signs": [-3.0, -2.0, 0.0, -0.0, 5.0, 9.0],
        "close": [1.0 + i * 2.0**-52 for i in range(1000)],
        "one": [4.0],
        "two": [4.0, 5.0],
        "infinite": [1.0, inf],
        "half_infinite": [1.0, 2.0, 3.0, inf, inf, inf],
        "both_infinite": [-inf, -inf, inf, inf],
        "low_infinite": [-inf, -inf, 1.0],
        "nan_last": [1.0, 2.0, 3.0, 4.0, nan],
        "mostly_nan": [1.0, nan, nan],
        "nan_and_infinite": [inf, inf, nan, nan],
        "wide": [-1.7e308, 1.7e308, 1e308],
    }
    data = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("one", None)], "k string, v double")
    found = dict(rows(exact_median(data, ["k"], "v")))
    expected = {k: _numpy_order_median(vs) for k, vs in values.items()}
    assert {k: str(v + 0.0) for k, v in found.items()} == {k: str(v + 0.0) for k, v in expected.items()}


def test_median_of_one_huge_group(spark):
    data = spark.range(0, 400_000, 1, 16).selectExpr(
        "CASE WHEN id % 50 = 0 THEN NULL ELSE 'hot' END AS k", "double(pmod(xxhash64(id), 1000003)) / 7 AS v"
    )
    expected = {r["k"]: r["m"] for r in data.groupBy("k").agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert {r["k"]: r["median"] for r in exact_median(data, ["k"], "v").collect()} == expected


def test_plans_are_built_without_jobs(spark, sf_dir):
    data = Fixtures(spark, sf_dir).iteration_records()
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        summary = query_summary(data)
        exact_median(data, ["dataset"], "elapsed")
        number_rows(data, ["dataset"], ["engine"], ["seq"])
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == []
        assert summary.columns
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_fixed_text_is_exact(spark):
    rng = random.Random(7)
    values = [1.005, 0.125, 2.5, 0.05, 8.345, 0.0, -1.005, -0.001, 99.995, 1e15 + 0.5] + [
        rng.randint(0, 10**6) / 1000 for _ in range(3000)
    ]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", to_fixed(F.col("v"), 1).alias("one"), to_fixed(F.col("v"), 2).alias("two")).collect():
        for digits, got in ((1, r["one"]), (2, r["two"])):
            exact = Decimal(abs(r["v"])).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP)
            assert got == ("-" if r["v"] < 0 else "") + str(exact)
    odd = spark.sql("SELECT double('NaN') AS n, double('Infinity') AS i, CAST(NULL AS DOUBLE) AS z")
    assert tuple(odd.select(*[to_fixed(F.col(x), 2) for x in "niz"]).head()) == ("NaN", "Infinity", None)


def test_division_and_rounding(spark):
    one = spark.range(1)
    value = lambda column: one.select(column.alias("v")).head()["v"]
    assert value(ratio(F.lit(1), F.lit(0))) == float("inf")
    assert value(F.isnan(ratio(F.lit(0), F.lit(0))))
    assert value(at_least(ratio(F.lit(0), F.lit(0)), 1.1)) is False
    assert [value(round_half_up(F.lit(x))) for x in (2.5, -2.5, 0.49)] == [3, -2, 0]


def test_natural_order(spark):
    order = lambda *ids: [
        r["id"] for r in spark.createDataFrame([(i,) for i in ids], "id string").orderBy(*natural_order()).collect()
    ]
    assert order("custom", "q10", "beta", "q2", "alpha", "q1") == ["q1", "q2", "q10", "alpha", "beta", "custom"]
    assert order("q1b", "q1a") == ["q1a", "q1b"]
    assert order("B", "_x", "a", "b", "A") == ["_x", "a", "A", "b", "B"]
    data = spark.createDataFrame([("d", i) for i in ("z", "q10", "q2", "q2a")], "dataset string, id string")
    assert rows(natural_positions(data, ["dataset"]), "position", "id") == [(1, "q2"), (2, "q2a"), (3, "q10"), (4, "z")]


def test_numbering_equals_a_window(spark):
    rng = random.Random(1)
    data = spark.createDataFrame(
        [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 5)}", rng.randint(0, 500), i) for i in range(2000)],
        "k string, t bigint, seq bigint",
    )
    numbered = number_rows(data, ["k"], [F.floor(F.col("t") / 50)], ["t", "seq"], "n", start=0)
    plain = data.selectExpr("k", "t", "seq", "cast(row_number() OVER (PARTITION BY k ORDER BY t, seq) - 1 AS bigint) AS n")
    assert rows(numbered, "k", "t", "seq", "n") == rows(plain)


def test_small_groups_are_numbered_where_they_lie(spark):
    rng = random.Random(2)
    data = [(None if j % 9 == 0 else j, rng.choice("xy"), rng.choice([None, *range(40)]), i) for i in range(600) for j in [rng.randint(0, 90)]]
    dealt = spark.createDataFrame(data, "k bigint, side string, t bigint, seq bigint").repartition("k")
    numbered = number_rows(dealt, ["k", "side"], [], ["t", "seq"], "n", start=0)
    plain = dealt.selectExpr("k", "side", "t", "seq", "cast(row_number() OVER (PARTITION BY k, side ORDER BY t, seq) - 1 AS bigint) AS n")
    assert numbered.schema["n"].dataType.simpleString() == "bigint"
    assert rows(numbered, "k", "side", "t", "seq", "n") == rows(plain)
    assert numbered._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_totals_of_pairs_are_those_of_timings(spark):
    rng = random.Random(3)
    data = [(rng.choice([None, *range(40)]), rng.choice(["base", "head", "other", None]), rng.choice([None, 0, 1, 2]), "d", rng.choice([None, 0.1, 1234.5678, rng.random() * 1e6])) for _ in range(2000)]
    timings = spark.createDataFrame(data, "job_id bigint, side string, pos bigint, dataset string, duration_ms double")
    assert rows(phase_totals(pair_timings(timings, sums=True), paired=True)) == rows(phase_totals(timings))
    assert pair_timings(timings).columns == ["job_id", "pos", "dataset", "base_ms", "head_ms"]


def test_query_sets_must_match_in_order(spark):
    listing = lambda *ids: spark.createDataFrame(
        [("d", p + 1, i) for p, i in enumerate(ids)], "dataset string, position bigint, id string"
    )
    verdict = lambda a, b: c.ordered_set_check(a, b).head()["verdict"]
    assert verdict(listing("q1", "q2"), listing("q1", "q2")) == "same"
    assert verdict(listing("q1", "q2"), listing("q2", "q1")) == "differ"
    assert verdict(listing("q1"), listing("q2")) == "differ"
    assert verdict(listing("q1"), listing()) == "head_empty"
    assert verdict(listing(), listing("q1")) == "base_empty"
