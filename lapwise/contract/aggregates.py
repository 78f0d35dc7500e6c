"""Aggregations and comparison scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapwise.contract.base import micros, query
from lapwise.contract.joins import COMPARED, MEDIAN, SUMMARY, compared
from lapwise.fixtures import Fixtures
from lapwise.functions.numbers import to_fixed
from lapwise.operators import comments, comparison, iterations, jobs, statements, timings
from lapwise.plans.compare import compare_pairs


@query("query_p50", f"WITH {SUMMARY} SELECT dataset, engine, id, successes, p50 FROM summary")
def query_p50(fx: Fixtures) -> DataFrame:
    return iterations.query_summary(fx.iteration_records()).select("dataset", "engine", "id", "successes", "p50")


@query("representative_time", f"WITH {SUMMARY} SELECT dataset, engine, id, failed, representative FROM summary")
def representative_time(fx: Fixtures) -> DataFrame:
    return iterations.query_summary(fx.iteration_records()).select(
        "dataset", "engine", "id", "failed", "representative"
    )


@query("average_tasks", f"WITH {SUMMARY} SELECT dataset, engine, id, average_tasks FROM summary")
def average_tasks(fx: Fixtures) -> DataFrame:
    return iterations.average_tasks(fx.iteration_records())


POOLED = f"""pooled AS (
  SELECT dataset, engine, statistic, {MEDIAN.format('v')} AS q_error
  FROM (SELECT i.dataset, i.engine, s.statistic,
               list_sort(list(CAST(CASE s.statistic WHEN 'p50' THEN i.stats_q_error_p50 ELSE i.stats_q_error_p95 END AS DOUBLE))) AS v
        FROM fx_iterations i JOIN compared c ON c.dataset = i.dataset AND c.id = i.id
          AND c.prev_time IS NOT NULL AND c.new_time IS NOT NULL,
             (VALUES ('p50'), ('p95')) s(statistic)
        WHERE i.stats_q_error_p50 IS NOT NULL GROUP BY 1, 2, 3) x)"""


@query("pooled_q_error", f"WITH {COMPARED}, {POOLED} SELECT * FROM pooled")
def pooled_q_error(fx: Fixtures) -> DataFrame:
    return comparison.pooled_q_errors(fx.iteration_records(), compared(fx))


TOTALS = f"""totals AS (
  SELECT dataset, count(*) AS compared, count(*) FILTER (t) AS timed,
         CAST(coalesce(sum(prev_time) FILTER (t), 0) AS BIGINT) AS prev_time,
         CAST(coalesce(sum(new_time) FILTER (t), 0) AS BIGINT) AS new_time,
         round(coalesce(sum(prev_tasks) FILTER (t AND prev_tasks IS NOT NULL AND new_tasks IS NOT NULL), 0), 6) AS prev_tasks,
         round(coalesce(sum(new_tasks) FILTER (t AND prev_tasks IS NOT NULL AND new_tasks IS NOT NULL), 0), 6) AS new_tasks
  FROM (SELECT *, prev_time IS NOT NULL AND new_time IS NOT NULL AS t FROM compared) c GROUP BY dataset),
judged AS (
  SELECT *, CASE WHEN new_time < prev_time THEN CASE WHEN new_time = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(prev_time AS DOUBLE) / new_time END
                 WHEN prev_time = 0 THEN CASE WHEN new_time = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST('Infinity' AS DOUBLE) END
                 ELSE CAST(new_time AS DOUBLE) / prev_time END AS factor,
         CASE WHEN new_time < prev_time THEN 'faster' ELSE 'slower' END AS direction
  FROM totals)"""


@query("run_totals", f"""
WITH {COMPARED}, {TOTALS} SELECT *, factor >= 1.1 AND NOT isnan(factor) AS highlighted FROM judged
""")
def run_totals(fx: Fixtures) -> DataFrame:
    return comparison.run_totals(compared(fx))


@query("sum_tasks", """
SELECT dataset, engine, CAST(coalesce(sum(tasks) FILTER (error IS NULL), 0) AS BIGINT) AS tasks
FROM fx_iterations WHERE id LIKE 'q%' GROUP BY 1, 2
""")
def sum_tasks(fx: Fixtures) -> DataFrame:
    return iterations.sum_tasks(fx.iteration_records())


@query("phase_totals", """
SELECT job_id, CAST(coalesce(sum(CAST(duration_ms AS DECIMAL(18,3))) FILTER (side = 'base'), 0) AS DOUBLE) AS base_ms,
       CAST(coalesce(sum(CAST(duration_ms AS DECIMAL(18,3))) FILTER (side = 'head'), 0) AS DOUBLE) AS head_ms,
       count(*) AS phases
FROM fx_timings GROUP BY 1
""")
def phase_totals(fx: Fixtures) -> DataFrame:
    records = fx._sql("SELECT l_orderkey AS job_id, CASE WHEN l_linestatus = 'O' THEN 'base' ELSE 'head' END AS side, "
                      "l_extendedprice AS duration_ms FROM lineitem")
    return timings.phase_totals(records)


@query("active_jobs", """
SELECT requested_by, count(*) AS active FROM fx_jobs WHERE status IN ('pending', 'running')
GROUP BY GROUPING SETS ((requested_by), ())
""")
def active_jobs(fx: Fixtures) -> DataFrame:
    return jobs.active_jobs(fx.jobs())


@query("first_error", """
SELECT dataset, engine, id, min_by(error, iteration) FILTER (error <> '') AS first_error
FROM fx_iterations GROUP BY 1, 2, 3
""")
def first_error(fx: Fixtures) -> DataFrame:
    return iterations.first_errors(fx.iteration_records(), order="seq")


@query("advance_scan_state", """
SELECT repository, epoch_us(max(scanned_through)) AS scanned_us
FROM (SELECT repository, updated_at AS scanned_through FROM fx_comments
      UNION ALL SELECT DISTINCT repository, TIMESTAMP '2024-01-30 22:00:00' FROM fx_comments) s GROUP BY 1
""")
def advance_scan_state(fx: Fixtures) -> DataFrame:
    feed = fx.comments()
    current = feed.select("repository").distinct().withColumn(
        "scanned_through", F.lit("2024-01-30 22:00:00").cast("timestamp")
    )
    observed = feed.select("repository", F.col("updated_at").alias("scanned_through"))
    state = comments.advance_scan_state(current, observed)
    return state.select("repository", micros("scanned_through").alias("scanned_us"))


@query("fold_statements", r"""
WITH p AS (SELECT *, TRY_CAST(nullif(regexp_extract(plan, '(?is)Output.*?([0-9]+)\s+rows', 1), '') AS BIGINT) AS n
           FROM fx_statement_pages),
s AS (SELECT statement_id, max_by(plan, page) FILTER (plan IS NOT NULL) AS plan,
             max(page) FILTER (n IS NOT NULL) AS set_page, max_by(n, page) FILTER (n IS NOT NULL) AS set_rows,
             max_by(elapsed_ms, page) FILTER (elapsed_ms IS NOT NULL) AS elapsed_ms
      FROM p GROUP BY 1)
SELECT s.statement_id, coalesce(any_value(s.plan), '') AS plan,
       CAST(coalesce(any_value(s.set_rows), 0) + coalesce(sum(p.data_rows) FILTER (p.plan IS NULL AND p.page > coalesce(s.set_page, -1)), 0) AS BIGINT) AS row_count,
       CAST(coalesce(any_value(s.elapsed_ms), 0) AS BIGINT) AS elapsed_ms
FROM s JOIN p ON p.statement_id = s.statement_id GROUP BY 1
""")
def fold_statements(fx: Fixtures) -> DataFrame:
    return statements.fold_statements(fx.statement_pages()).drop("error")


@query("job_status_counts", """
SELECT status, count(*) AS jobs, count(*) FILTER (status = 'running' AND attempt_count < 3) AS retried,
       count(*) FILTER (status = 'running' AND attempt_count >= 3) AS failed FROM fx_jobs GROUP BY 1
""")
def job_status_counts(fx: Fixtures) -> DataFrame:
    return jobs.job_status_counts(fx.jobs())


# --- comparison scalars -------------------------------------------------------


@query("comparison_outcome", f"WITH {COMPARED} SELECT dataset, outcome, count(*) AS queries FROM compared GROUP BY 1, 2")
def comparison_outcome(fx: Fixtures) -> DataFrame:
    return compared(fx).groupBy("dataset", "outcome").agg(F.count(F.lit(1)).alias("queries"))


# Pairs of times with zeros on either side.
_PAIRS = """SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_custkey % 400 END AS BIGINT) AS prev,
    CAST(CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_orderkey % 300 END AS BIGINT) AS new FROM orders"""
_FACTOR = """CASE WHEN new < prev THEN CASE WHEN new = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(prev AS DOUBLE) / new END
    WHEN prev = 0 THEN CASE WHEN new = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST('Infinity' AS DOUBLE) END
    ELSE CAST(new AS DOUBLE) / prev END"""


@query("change_factor", f"""
SELECT id, CASE WHEN isnan(f) THEN 'undefined' WHEN isinf(f) THEN 'infinite' ELSE 'finite' END AS kind,
       CASE WHEN isnan(f) OR isinf(f) THEN NULL ELSE f END AS factor
FROM (SELECT id, {_FACTOR} AS f FROM ({_PAIRS}) p) x
""")
def change_factor(fx: Fixtures) -> DataFrame:
    factor = comparison.change_factor(F.col("prev"), F.col("new"))
    infinite = F.col("f") == float("inf")
    return fx._sql(_PAIRS).select("id", factor.alias("f")).select(
        "id",
        F.when(F.isnan("f"), "undefined").when(infinite, "infinite").otherwise("finite").alias("kind"),
        F.when(~F.isnan("f") & ~infinite, F.col("f")).alias("factor"),
    )


@query("highlight", f"""
SELECT id, f >= 1.5 AND NOT isnan(f) AS query_highlighted, f >= 1.1 AND NOT isnan(f) AS total_highlighted
FROM (SELECT id, {_FACTOR} AS f FROM ({_PAIRS}) p) x
""")
def highlight(fx: Fixtures) -> DataFrame:
    factor = comparison.change_factor(F.col("prev"), F.col("new"))
    return fx._sql(_PAIRS).select("id", factor.alias("f")).select(
        "id",
        comparison.at_least(F.col("f"), comparison.QUERY_THRESHOLD).alias("query_highlighted"),
        comparison.at_least(F.col("f"), comparison.TOTAL_THRESHOLD).alias("total_highlighted"),
    )


@query("task_change", f"""
WITH {COMPARED}
SELECT dataset, id, CASE WHEN prev_tasks IS NULL OR new_tasks IS NULL THEN NULL WHEN prev_tasks = new_tasks THEN 'no change'
            WHEN new_tasks < prev_tasks THEN 'fewer' ELSE 'more' END AS task_direction,
       abs(new_tasks - prev_tasks) AS task_delta,
       CASE WHEN prev_tasks <> 0 AND prev_tasks <> new_tasks THEN abs(new_tasks - prev_tasks) / prev_tasks * 100 END AS task_percent
FROM compared
""")
def task_change(fx: Fixtures) -> DataFrame:
    return comparison.task_change(compared(fx)).select("dataset", "id", "task_direction", "task_delta", "task_percent")


def pairs(fx: Fixtures) -> DataFrame:
    return fx.iteration_records().select("dataset").distinct().select(
        "dataset", F.lit("base").alias("prev_engine"), F.lit("head").alias("new_engine")
    )


def fixed_text(x: str, digits: int) -> str:
    """Fixed-point text; an exact tie goes up, where printf goes to the even digit."""
    parts, half = {1: (4, 0.05), 2: (8, 0.005)}[digits]
    tie = f"({x}) * {parts} = floor(({x}) * {parts}) AND CAST(({x}) * {parts} AS BIGINT) % 2 <> 0"
    return f"CASE WHEN {tie} THEN printf('%.{digits}f', ({x}) + {half}) ELSE printf('%.{digits}f', ({x})) END"


def _padded(x: str, width: int) -> str:
    return f"CASE WHEN length({x}) >= {width} THEN {x} ELSE lpad({x}, {width}, ' ') END"


def _task_text(prev: str, new: str) -> str:
    delta = f"abs({new} - {prev})"
    return (
        f"'prev=' || {fixed_text(prev, 1)} || ', new=' || {fixed_text(new, 1)} || ', diff=' || "
        f"CASE WHEN {new} = {prev} THEN 'no change' WHEN {prev} = 0 THEN {fixed_text(new, 1)} || ' more' "
        f"ELSE {fixed_text(delta, 1)} || CASE WHEN {new} < {prev} THEN ' fewer (' ELSE ' more (' END "
        f"|| {fixed_text(f'{delta} / {prev} * 100', 1)} || '%)' END"
    )


def _marked(kind: str, threshold: float) -> str:
    return (
        f"CASE WHEN {kind} = 'faster' THEN CASE WHEN factor >= {threshold} THEN '✅' ELSE '✔' END "
        f"ELSE CASE WHEN factor >= {threshold} THEN '❌' ELSE '✖' END END"
    )


_Q_ERROR = lambda engine: f"coalesce(max({fixed_text('q_error', 2)} || 'x') FILTER (engine = '{engine}'), 'n/a')"
LINES = f"""{COMPARED}, {POOLED}, {TOTALS}, texts AS (
  SELECT dataset, 0 AS section, CAST(NULL AS VARCHAR) AS id,
         '=== Comparing ' || dataset || ' results ''base'' [prev] with ''head'' [new] ===' AS line FROM totals
  UNION ALL SELECT dataset, 1, id, CASE outcome
    WHEN 'recovered' THEN id || ': Previously failed, but now succeeded 🟠'
    WHEN 'newly_failed' THEN id || ': Previously succeeded, but now failed ❌'
    WHEN 'still_failing' THEN id || ': Previously failed, and now also failed ❌'
    ELSE {_padded('id', 8)} || ': prev=' || {_padded('CAST(prev_p50 AS VARCHAR)', 4)} || ' ms, new='
      || {_padded('CAST(new_p50 AS VARCHAR)', 4)} || ' ms, diff=' || {fixed_text('factor', 2)} || ' ' || outcome || ' '
      || {_marked('outcome', 1.5)} || CASE WHEN prev_tasks IS NULL OR new_tasks IS NULL THEN ''
         ELSE ', tasks: ' || {_task_text('prev_tasks', 'new_tasks')} END END FROM compared
  UNION ALL SELECT dataset, CASE statistic WHEN 'p50' THEN 2 ELSE 3 END, NULL,
         'QERR ' || upper(statistic) || ': prev=' || {_Q_ERROR('base')} || ', new=' || {_Q_ERROR('head')}
  FROM pooled GROUP BY dataset, statistic
  UNION ALL SELECT dataset, 4, NULL, '   TASKS: ' || {_task_text('prev_tasks', 'new_tasks')} || ' (sum of per-query averages)' FROM judged
  UNION ALL SELECT dataset, 5, NULL, '   TOTAL: prev=' || prev_time || ' ms, new=' || new_time || ' ms, diff='
         || {fixed_text('factor', 2)} || ' ' || direction || ' ' || {_marked('direction', 1.1)} FROM judged)"""


@query("q_error_line", f"WITH {LINES} SELECT dataset, section, line FROM texts WHERE section IN (2, 3)")
def q_error_line(fx: Fixtures) -> DataFrame:
    pooled = comparison.pooled_q_errors(fx.iteration_records(), compared(fx))
    return comparison.q_error_lines(pooled, pairs(fx))


@query("comparison_lines", f"WITH {LINES} SELECT * FROM texts")
def comparison_lines(fx: Fixtures) -> DataFrame:
    lines = compare_pairs(fx.iteration_records(), pairs(fx)).lines()
    return lines.orderBy(*comparison.line_order())


@query("comparison_lines_numeric", f"""
WITH {COMPARED}
SELECT dataset, id, prev_p50, new_p50, outcome, CASE WHEN outcome IN ('faster', 'slower') THEN true ELSE false END AS has_times
FROM compared
""")
def comparison_lines_numeric(fx: Fixtures) -> DataFrame:
    """The numbers read back from the rendered lines, where a line shows them."""
    result = compare_pairs(fx.iteration_records(), pairs(fx))
    lines = result.lines().where("section = 1")
    number = lambda pattern: F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")).cast("bigint")
    shown = lines.select(
        "dataset", "id", number(r"prev=\s*([0-9]+) ms").alias("p"), number(r"new=\s*([0-9]+) ms").alias("n"),
        F.col("line").contains(" ms, diff=").alias("has_times"),
    )
    joined = shown.join(result.queries, ["dataset", "id"])
    return joined.select(
        "dataset", "id",
        F.when(F.col("has_times"), F.col("p")).otherwise(F.col("prev_p50")).alias("prev_p50"),
        F.when(F.col("has_times"), F.col("n")).otherwise(F.col("new_p50")).alias("new_p50"),
        "outcome", "has_times",
    )


@query("to_fixed", f"SELECT event_id, {fixed_text('value / 8', 2)} AS text FROM events")
def fixed(fx: Fixtures) -> DataFrame:
    return fx.table("events").select("event_id", to_fixed(F.col("value") / 8, 2).alias("text"))
