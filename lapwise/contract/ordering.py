"""Ordering, ranking and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapwise.contract.base import micros, query
from lapwise.contract.predicates import EXPECTED_COMMANDS
from lapwise.contract.scans import NATURAL
from lapwise.fixtures import Fixtures
from lapwise.functions.commands import parse_commands
from lapwise.operators import admission, catalog, comments, iterations, jobs, runs
from lapwise.operators.ordering import natural_positions
from lapwise.session import cut

POLLED_AT = "2024-02-01 00:00:00"


@query("natural_query_order", f"""
SELECT dataset, id, row_number() OVER (PARTITION BY dataset ORDER BY {NATURAL.format('id')}) AS position
FROM (SELECT DISTINCT dataset, id FROM fx_iterations) i
""")
def natural_query_order(fx: Fixtures) -> DataFrame:
    ids = fx.iteration_records().select("dataset", "id").distinct()
    return natural_positions(ids, ["dataset"]).select("dataset", "id", "position")


@query("next_pending", """
SELECT id, requested_by, CAST(attempt_count AS BIGINT) AS attempt_count FROM fx_jobs
WHERE status = 'pending' AND status_comment_id IS NOT NULL ORDER BY id LIMIT 1
""")
def next_pending(fx: Fixtures) -> DataFrame:
    return jobs.next_pending(fx.jobs()).select("id", "requested_by", "attempt_count")


ADMITTED = """requests AS (
  SELECT queue, login AS requested_by, comment_id, updated_at FROM fx_comments
  WHERE comment_id % 12 IN (0, 1, 2, 10)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY queue, requested_by ORDER BY updated_at, comment_id) AS r FROM requests),
counted AS (SELECT *, coalesce(sum(CASE WHEN r <= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY queue ORDER BY updated_at, comment_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked)"""


def parsed_requests(fx: Fixtures) -> DataFrame:
    """The requests among the comments, parsed once as admission reads them twice."""
    requests = parse_commands(fx.comments()).where("kind = 'request'")
    return cut(
        requests.select(
            "queue", F.col("login").alias("requested_by"), "comment_id", F.col("updated_at").alias("arrived_at")
        ),
        "requests",
    )


@query("admit_requests", f"""
WITH {ADMITTED}
SELECT queue, comment_id, requested_by, CASE WHEN before >= 20 THEN 'queue_full' WHEN r > 3 THEN 'requester_limit' ELSE 'admitted' END AS decision
FROM counted
""")
def admit_requests(fx: Fixtures) -> DataFrame:
    requests = parsed_requests(fx)
    active = fx.spark.createDataFrame([], "queue bigint, requested_by string, active bigint")
    return admission.admit_requests(requests, active).select("queue", "comment_id", "requested_by", "decision")


@query("admit_requests_busy", """
WITH requests AS (
  SELECT queue, login AS requested_by, comment_id, updated_at FROM fx_comments WHERE comment_id % 12 IN (0, 1, 2, 10)),
active AS (SELECT id // 12 AS queue, requested_by, count(*) AS n FROM fx_jobs
           WHERE status IN ('pending', 'running') GROUP BY 1, 2),
full_queues AS (SELECT queue, sum(n) AS n FROM active GROUP BY 1),
ranked AS (SELECT r.*, row_number() OVER (PARTITION BY r.queue, r.requested_by ORDER BY updated_at, comment_id) <= 3 - coalesce(a.n, 0) AS candidate
           FROM requests r LEFT JOIN active a ON a.queue = r.queue AND a.requested_by = r.requested_by),
counted AS (SELECT *, coalesce(sum(CASE WHEN candidate THEN 1 ELSE 0 END) OVER (PARTITION BY queue ORDER BY updated_at, comment_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked)
SELECT c.queue, comment_id, CASE WHEN before >= 20 - coalesce(f.n, 0) THEN 'queue_full' WHEN NOT candidate THEN 'requester_limit' ELSE 'admitted' END AS decision
FROM counted c LEFT JOIN full_queues f ON f.queue = c.queue
""")
def admit_requests_busy(fx: Fixtures) -> DataFrame:
    """The same against queues that hold active jobs already."""
    requests = parsed_requests(fx)
    busy = fx.jobs().withColumn("queue", F.floor(F.col("id") / 12))
    return admission.admit_requests(requests, admission.active_by_requester(busy)).select(
        "queue", "comment_id", "decision"
    )


@query("settled_watermark", f"""
WITH blocked AS (SELECT repository, min(updated_at) FILTER (NOT settled) AS at, min_by(comment_id, updated_at) FILTER (NOT settled) AS id,
                        bool_and(settled) AS every FROM fx_comments GROUP BY 1),
newest AS (SELECT c.repository, max(c.updated_at) AS newest FROM fx_comments c JOIN blocked b ON b.repository = c.repository
           WHERE c.settled AND (b.at IS NULL OR c.updated_at < b.at OR (c.updated_at = b.at AND c.comment_id < b.id)) GROUP BY 1)
SELECT b.repository, epoch_us(greatest(n.newest - INTERVAL '2' MINUTE,
         CASE WHEN b.every THEN TIMESTAMP '{POLLED_AT}' - INTERVAL '2' MINUTE END, TIMESTAMP '2024-01-01 00:00:00')) AS scanned_us
FROM blocked b LEFT JOIN newest n ON n.repository = b.repository
""")
def settled_watermark(fx: Fixtures) -> DataFrame:
    feed = fx.comments()
    current = feed.select("repository").distinct().withColumn(
        "scanned_through", F.lit("2024-01-01 00:00:00").cast("timestamp")
    )
    state = comments.settled_watermark(feed, current, F.lit(POLLED_AT).cast("timestamp"))
    return state.select("repository", micros("scanned_through").alias("scanned_us"))


@query("retry_schedule", """
SELECT comment_id, n AS attempt, CAST(least(300, 30 * 2 ** (n - 1)) AS BIGINT) AS delay_seconds,
       epoch_us(failed_at + to_seconds(CAST(least(300, 30 * 2 ** (n - 1)) AS INTEGER))) AS next_us,
       substr(error, 1, 4000) AS last_error, n >= 3 AS dropped
FROM (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY failed_at, failure_id) AS n FROM fx_failures) f WHERE n <= 3
""")
def retry_schedule(fx: Fixtures) -> DataFrame:
    schedule = comments.retry_schedule(fx.failures())
    return schedule.withColumn("next_us", micros("next_attempt_at")).drop("next_attempt_at")


@query("iteration_index", """
SELECT dataset, engine, id, iteration, CAST(elapsed AS DOUBLE) AS elapsed FROM fx_iterations
""")
def iteration_index(fx: Fixtures) -> DataFrame:
    return iterations.iteration_index(fx.iteration_records()).select("dataset", "engine", "id", "iteration", "elapsed")


@query("progress_steps", f"""
WITH d AS (SELECT comment_id, string_split(datasets, ',') AS ds FROM ({EXPECTED_COMMANDS}) c WHERE kind = 'request'),
s AS (SELECT comment_id, ['Checking out the base revision', 'Validating all requested datasets', 'Deploying the base revision']
        || list_transform(ds, lambda x: 'Benchmarking base: ' || x) || ['Checking out the PR-head revision', 'Deploying the PR-head revision']
        || list_transform(ds, lambda x: 'Benchmarking PR head: ' || x) || ['Destroying the benchmark deployment'] AS steps FROM d)
SELECT comment_id, u.step, len(steps) AS total, steps[u.step] AS message FROM s, unnest(generate_series(1, len(steps))) AS u(step)
""")
def progress_steps(fx: Fixtures) -> DataFrame:
    return jobs.progress_steps(parse_commands(fx.comments()).where("kind = 'request'"), ("comment_id",))


# Runs of a dataset stored at different times, derived from the orders.
_RUNS = """SELECT 'tpch/sf' || CAST(o_custkey % 5 AS STRING) AS dataset, 'run-' || CAST(o_orderkey AS STRING) AS engine,
    CAST(o_orderkey % 3000 AS BIGINT) * 7200 AS stored_at FROM orders"""


@query("previous_run_pairs", f"""
SELECT dataset, engine, stored_at, row_number() OVER w AS run, lag(engine) OVER w AS previous_engine
FROM ({_RUNS}) r WINDOW w AS (PARTITION BY dataset ORDER BY stored_at, engine)
""")
def previous_run_pairs(fx: Fixtures) -> DataFrame:
    return runs.previous_run_pairs(fx._sql(_RUNS))


# --- set operations -------------------------------------------------------------

_REQUESTED = "SELECT o_orderkey AS pos, 'tpch/sf' || CAST(o_custkey % 7 AS STRING) AS dataset FROM orders"


@query("distinct_requested", f"SELECT dataset, min(pos) AS pos FROM ({_REQUESTED}) r GROUP BY 1")
def distinct_requested(fx: Fixtures) -> DataFrame:
    return catalog.distinct_requested(fx._sql(_REQUESTED))


@query("duplicate_ids", """
SELECT comment_id, id, count(*) AS times
FROM (SELECT comment_id, unnest(regexp_extract_all(body, '[a-z_]+/[a-z0-9-]+')) AS id FROM fx_comments) w
GROUP BY 1, 2 HAVING count(*) > 1
""")
def duplicate_ids(fx: Fixtures) -> DataFrame:
    words = F.explode(F.regexp_extract_all("body", F.lit("([a-z_]+/[a-z0-9-]+)")))
    return catalog.duplicate_ids(fx.comments().select("comment_id", words.alias("id")), ["comment_id"])


def report_jobs(fx: Fixtures) -> DataFrame:
    """Jobs that compare two or three of the datasets."""
    dataset = lambda n: F.element_at(
        F.array(*[F.lit(f"ev/{t}") for t in ("click", "error", "purchase", "signup", "view")]),
        ((F.col("o_orderkey") + n) % 5 + 1).cast("int"),
    )
    return fx.table("orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(dataset(0), dataset(2)))
        .otherwise(F.array(dataset(4), dataset(1), dataset(3))).alias("datasets"),
    )


def pairs(fx: Fixtures) -> DataFrame:
    return fx.iteration_records().select("dataset").distinct().select(
        "dataset", F.lit("base").alias("prev_engine"), F.lit("head").alias("new_engine")
    )
