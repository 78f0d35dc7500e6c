"""Running a SQL corpus and recording every iteration."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from lapwise.functions import sqltext

ITERATION_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType(), False),
        T.StructField("engine", T.StringType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("iteration", T.LongType(), False),
        T.StructField("elapsed", T.DoubleType(), False),
        T.StructField("row_count", T.LongType(), False),
        T.StructField("tasks", T.LongType(), False),
        T.StructField("stats_q_error_p50", T.DoubleType()),
        T.StructField("stats_q_error_p95", T.DoubleType()),
        T.StructField("error", T.StringType()),
        T.StructField("plan", T.StringType(), False),
    ]
)


@dataclass(frozen=True)
class Measurement:
    """What one execution of a query yields."""

    row_count: int
    elapsed: float
    tasks: int
    plan: str


FAILED = Measurement(0, 0.0, 0, "")


def prepare(sql: str) -> list[str]:
    """Statements of a query text as Spark runs them: one, or the three of a view query.

    The same patterns as the corpus rewrites, for a text that is run now.
    """
    sql = re.sub(sqltext.DATE_LITERAL, r"DATE \1", sql)
    sql = re.sub(sqltext.EPOCH_FUNCTION, "timestamp_seconds(", sql)
    if not re.search(sqltext.HAS_VIEW, sql):
        return [sql.strip().rstrip(";")]
    statements = [part.strip() for part in sql.split(";") if part.strip()]
    if len(statements) != 3:
        raise ValueError("Expected CREATE VIEW benchmark query to contain three statements")
    return [re.sub(sqltext.CREATE_VIEW, "CREATE OR REPLACE TEMPORARY VIEW ", statements[0]), *statements[1:]]


def execute(spark: SparkSession, sql: str) -> Measurement:
    """Run one query completely and measure it.

    The no-op sink computes every column of every row, which a count would let
    the optimizer skip; rows are counted on the way.  Set-up and clean-up of a
    view query are not timed.
    """
    statements = prepare(sql)
    query = statements[1] if len(statements) == 3 else statements[0]
    if len(statements) == 3:
        spark.sql(statements[0])
    context = spark.sparkContext
    group = f"lapwise-{uuid.uuid4().hex}"
    context.setJobGroup(group, "measured query", False)
    try:
        started = time.perf_counter()
        observed = Observation()
        result = spark.sql(query).observe(observed, F.count(F.lit(1)).alias("rows"))
        result.write.format("noop").mode("overwrite").save()
        elapsed = (time.perf_counter() - started) * 1000
        plan = spark.sql(f"EXPLAIN FORMATTED {query}").head()[0]
        return Measurement(int(observed.get.get("rows", 0)), elapsed, _task_count(spark, group), plan)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        if len(statements) == 3:
            spark.sql(statements[2])


def _task_count(spark: SparkSession, group: str) -> int:
    tracker = spark.sparkContext.statusTracker()
    stages = set()
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        stages.update(info.stageIds if info else ())
    infos = [tracker.getStageInfo(stage) for stage in stages]
    return sum(info.numCompletedTasks for info in infos if info)


def run_suite(
    spark: SparkSession,
    queries: Iterable[tuple[str, str]],
    dataset: str,
    engine: str,
    iterations: int = 5,
    min_seconds: float = 0.0,
    warmup: bool = True,
    selected: Sequence[str] = (),
    run: Callable[[SparkSession, str], Measurement] = execute,
    clock: Callable[[], float] = time.monotonic,
) -> DataFrame:
    """Measure the queries one after another and return their iterations.

    Both minimums must hold: the number of iterations and the seconds per
    query.  A failing warm-up leaves one failed iteration; a failing iteration
    is recorded and ends its query, keeping earlier successes.  Unknown ids
    stop the run before anything is measured.
    """
    if iterations <= 0:
        raise ValueError(f"Iterations must be a positive integer, got {iterations}")
    if not 0 <= min_seconds < float("inf"):
        raise ValueError(f"Time must be a non-negative number of seconds, got {min_seconds}")
    corpus = list(queries)
    unknown = [q for q in selected if q not in {id for id, _ in corpus}]
    if unknown:
        raise ValueError(f"Unknown query ID(s) for '{dataset}': {', '.join(unknown)}")

    records = []
    for id, sql in corpus:
        if selected and id not in selected:
            continue
        measured: list[tuple[Measurement, str | None]] = []
        try:
            if warmup:
                run(spark, sql)
            started = clock()
            while len(measured) < iterations or clock() - started < min_seconds:
                measured.append((run(spark, sql), None))
        except Exception as error:  # a failing query is a result, not a failed run
            measured.append((FAILED, str(error) or type(error).__name__))
        records += [
            {"dataset": dataset, "engine": engine, "id": id, "iteration": i, "error": error, **asdict(m)}
            for i, (m, error) in enumerate(measured)
        ]
    return spark.createDataFrame(records, ITERATION_SCHEMA)
