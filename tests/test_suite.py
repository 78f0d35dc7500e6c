"""Running a corpus."""

import re
import uuid
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from conftest import rows
from lapwise import session
from lapwise.contract import workloads
from lapwise.fixtures import Fixtures
from lapwise.operators.iterations import query_summary
from lapwise.plans.compare import compare_pairs
from lapwise.sources import results
from lapwise.plans import suite
from lapwise.plans.suite import Measurement, run_suite

OK = Measurement(1, 10.0, 2, "plan")


class Clock:
    def __init__(self, step):
        self.now, self.step, self.calls = 0.0, step, []

    def __call__(self):
        return self.now

    def run(self, spark, sql):
        self.calls.append(sql)
        self.now += self.step
        if "fail" in sql and self.calls.count(sql) >= 2:
            raise RuntimeError("lost")
        return OK


def test_both_minimums_hold(spark):
    clock = Clock(4)
    run_suite(spark, [("q1", "s")], "d/v", "e", iterations=2, min_seconds=10, warmup=False, run=clock.run, clock=clock)
    assert len(clock.calls) == 3
    clock = Clock(4)
    run_suite(spark, [("q1", "s")], "d/v", "e", iterations=5, min_seconds=10, warmup=True, run=clock.run, clock=clock)
    assert len(clock.calls) == 6


def test_failures_are_results(spark):
    clock = Clock(1)
    measured = run_suite(
        spark, [("q1", "fail"), ("q2", "ok")], "d/v", "e", iterations=3, warmup=False, run=clock.run, clock=clock
    )
    assert rows(measured, "id", "iteration", "elapsed", "row_count", "tasks", "error", "plan") == [
        ("q1", 0, 10.0, 1, 2, None, "plan"), ("q1", 1, 0.0, 0, 0, "lost", ""),
        ("q2", 0, 10.0, 1, 2, None, "plan"), ("q2", 1, 10.0, 1, 2, None, "plan"), ("q2", 2, 10.0, 1, 2, None, "plan"),
    ]
    broken = run_suite(spark, [("q1", "SELECT nothing FROM nowhere")], "d/v", "e")
    assert broken.count() == 1 and broken.head()["error"]


def test_options_are_checked_first(spark):
    clock = Clock(1)
    for wrong in ({"iterations": 0}, {"min_seconds": -1}, {"min_seconds": float("nan")}, {"selected": ["q9"]}):
        with pytest.raises(ValueError):
            run_suite(spark, [("q1", "s")], "d/v", "e", run=clock.run, clock=clock, **wrong)
    assert clock.calls == []


def test_measuring(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    measured = suite.execute(spark, "SELECT l_orderkey FROM lineitem WHERE l_shipdate >= '1995-01-01' ORDER BY 1;")
    assert measured.row_count > 0 and measured.elapsed > 0 and measured.tasks > 0 and "Scan parquet" in measured.plan


def test_views_are_dropped(spark):
    sql = "create view v1 (a) as select 1; select * from v1; drop view v1;"
    assert suite.execute(spark, sql).row_count == 1
    assert not spark.catalog.tableExists("v1")


def test_work_folders(spark):
    assert session.work_dir(spark, "x") != session.work_dir(spark, "x")
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: "/shared/"))
    assert session.work_dir(cluster, "x").startswith("/shared/x-")
    bare = SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master="yarn")
    )
    with pytest.raises(ValueError, match="shared folder"):
        session.work_dir(bare, "x")


@pytest.mark.parametrize("id", sorted(workloads.REPORTS))
def test_subqueries_become_joins(spark, sf_dir, id):
    """No pair of all rows is left in a plan: subqueries are outer, semi and anti joins on keys."""
    workloads._register(Fixtures(spark, sf_dir), workloads.REPORTS[id])
    plan = spark.sql(f"EXPLAIN FORMATTED {workloads.REPORTS[id]}").head()[0]
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    joins = {"q13": "LeftOuter|RightOuter", "q22": "LeftAnti", "not_in": "LeftAnti", "set_operations": "LeftAnti"}
    assert id not in joins or re.search(joins[id], plan)


def _nodes_below(plan, name):
    """Names of the nodes below the lowest node of a name in a plan text."""
    lines = plan.split("\n")
    last = max(i for i, line in enumerate(lines) if name in line)
    return "\n".join(lines[last + 1 :])


def test_stored_runs_are_compared_without_a_shuffle(spark, tmp_path):
    runs = spark.range(4_000).select(
        F.lit("d/v").alias("dataset"), F.when(F.col("id") % 2 == 0, "base").otherwise("head").alias("engine"),
        F.concat(F.lit("q"), (F.col("id") % 7).cast("string")).alias("query"), F.col("id").alias("iteration"),
        (F.col("id") % 97).cast("double").alias("elapsed"), F.lit(1).cast("bigint").alias("row_count"), F.lit(3).cast("bigint").alias("tasks"),
        F.lit(1.5).alias("stats_q_error_p50"), F.lit(2.5).alias("stats_q_error_p95"), F.lit(None).cast("string").alias("error"),
    ).withColumnRenamed("query", "id")
    table = f"stored_test_{uuid.uuid4().hex}"
    results.store_iterations(runs.where("engine = 'base'"), table, f"{tmp_path}/t", buckets=4)
    results.store_iterations(runs.where("engine = 'head'"), table, buckets=4)
    pair = spark.createDataFrame([("d/v", "base", "head")], "dataset string, prev_engine string, new_engine string")
    try:
        stored = spark.table(table)
        sides = F.broadcast(spark.createDataFrame([("d/v", "base"), ("d/v", "head")], "dataset string, engine string"))
        summary = query_summary(stored.join(sides, ["dataset", "engine"], "left_semi"))
        plan = summary._jdf.queryExecution().executedPlan().toString()
        first = _nodes_below(plan, "ObjectHashAggregate")
        assert "Bucketed: true" in first and "Exchange hashpartitioning" not in first
        compared = compare_pairs(stored, pair)
        assert rows(compared.totals) == rows(compare_pairs(runs, pair).totals)
    finally:
        spark.sql(f"DROP TABLE {table}")
