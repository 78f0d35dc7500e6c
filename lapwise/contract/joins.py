"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapwise.contract.base import query
from lapwise.contract.predicates import ISSUE_NUMBER
from lapwise.contract.scans import LISTED, manifest_entries
from lapwise.fixtures import Fixtures
from lapwise.functions.names import issue_number
from lapwise.operators import catalog, comments, comparison, jobs, timings
from lapwise.operators.iterations import query_summary
from lapwise.plans.compare import query_set_check
from lapwise.sources import results

# Exact medians from sorted lists, rounded half up.
MEDIAN = "CASE WHEN len({0}) = 0 THEN NULL ELSE ({0}[(len({0}) + 1) // 2] + {0}[len({0}) // 2 + 1]) / 2 END"
SUMMARY = f"""summary AS (
  SELECT dataset, engine, id, iterations, successes, failed,
         CAST(floor(coalesce({MEDIAN.format('v')}, 0.0) + 0.5) AS BIGINT) AS p50,
         CASE WHEN NOT failed THEN CAST(floor(coalesce({MEDIAN.format('v')}, 0.0) + 0.5) AS BIGINT) END AS representative,
         CASE WHEN successes > 0 THEN CAST(tasks AS DOUBLE) / successes END AS average_tasks
  FROM (SELECT dataset, engine, id, count(*) AS iterations, count(*) FILTER (coalesce(error, '') = '') AS successes,
               bool_or(coalesce(error, '') <> '') AS failed,
               list_sort(coalesce(list(CAST(elapsed AS DOUBLE)) FILTER (coalesce(error, '') = ''), [])) AS v,
               sum(tasks) FILTER (coalesce(error, '') = '') AS tasks
        FROM fx_iterations GROUP BY 1, 2, 3) s)"""
COMPARED = f"""{SUMMARY}, compared AS (
  SELECT *, CASE WHEN pf AND nf THEN 'still_failing' WHEN pf THEN 'recovered' WHEN nf THEN 'newly_failed'
                 WHEN new_p50 < prev_p50 THEN 'faster' ELSE 'slower' END AS outcome,
         CASE WHEN pf OR nf THEN NULL
              WHEN new_p50 < prev_p50 THEN CASE WHEN new_p50 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(prev_p50 AS DOUBLE) / new_p50 END
              WHEN prev_p50 = 0 THEN CASE WHEN new_p50 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST('Infinity' AS DOUBLE) END
              ELSE CAST(new_p50 AS DOUBLE) / prev_p50 END AS factor
  FROM (SELECT b.dataset, b.id, b.p50 AS prev_p50, h.p50 AS new_p50, b.representative AS prev_time, h.representative AS new_time,
               b.failed AS pf, h.failed AS nf, b.average_tasks AS prev_tasks, h.average_tasks AS new_tasks
        FROM summary b JOIN summary h ON b.dataset = h.dataset AND b.id = h.id AND b.engine = 'base' AND h.engine = 'head') x)"""


def compared(fx: Fixtures) -> DataFrame:
    return comparison.compare_queries(comparison.pivot_runs(query_summary(fx.iteration_records()), "base", "head"))


@query("compare_queries", f"""
WITH {COMPARED}
SELECT dataset, id, prev_p50, new_p50, prev_time, new_time, prev_tasks, new_tasks, outcome, factor,
       coalesce(factor >= 1.5 AND NOT isnan(factor), false) AS highlighted FROM compared
""")
def compare_queries(fx: Fixtures) -> DataFrame:
    return compared(fx)


@query("query_set_check", f"""
WITH {LISTED}, b AS (SELECT * FROM listed WHERE engine = 'base'), h AS (SELECT * FROM listed WHERE engine = 'head'),
counted AS (
  SELECT coalesce(b.dataset, h.dataset) AS dataset, count(b.id) AS base_count, count(h.id) AS head_count,
         count(*) FILTER (b.id IS DISTINCT FROM h.id) AS differences
  FROM b FULL JOIN h ON b.dataset = h.dataset AND b.position = h.position GROUP BY 1)
SELECT *, CASE WHEN base_count = 0 THEN 'base_empty' WHEN head_count = 0 THEN 'head_empty'
               WHEN differences > 0 THEN 'differ' ELSE 'same' END AS verdict FROM counted
""")
def set_check(fx: Fixtures) -> DataFrame:
    manifests = manifest_entries(fx)
    pairs = manifests.select("dataset").distinct().select(
        "dataset", F.lit("base").alias("prev_engine"), F.lit("head").alias("new_engine")
    )
    return query_set_check(fx.iteration_records(), manifests, pairs)


@query("missing_results", """
SELECT dataset, engine, id FROM fx_manifests m
WHERE NOT EXISTS (SELECT 1 FROM fx_iterations i WHERE i.dataset = m.dataset AND i.engine = m.engine AND i.id = m.id)
""")
def missing_results(fx: Fixtures) -> DataFrame:
    return results.missing_results(fx.iteration_records(), fx.manifests())


_REQUESTED = "SELECT 'q' || CAST(o_custkey % 40 AS STRING) AS id FROM orders"


@query("unknown_ids", f"""
SELECT DISTINCT id FROM ({_REQUESTED}) r WHERE id NOT IN (SELECT id FROM fx_iterations)
""")
def unknown_ids(fx: Fixtures) -> DataFrame:
    return catalog.unknown_names(fx.iteration_records(), fx._sql(_REQUESTED), "id")


@query("authorised", """
SELECT comment_id, login FROM fx_comments
WHERE TRY_CAST(regexp_extract(lower(login), '^user([0-9]+)$', 1) AS INT) < 25
""")
def authorised(fx: Fixtures) -> DataFrame:
    return comments.authorised(fx.comments(), fx.allow_list()).select("comment_id", "login")


@query("unhandled_comments", """
SELECT c.comment_id, c.login FROM fx_comments c LEFT JOIN fx_jobs j ON j.comment_id = c.comment_id
WHERE NOT (c.comment_id % 13 = 0 AND (j.comment_id IS NULL OR j.status_comment_id IS NOT NULL))
""")
def unhandled(fx: Fixtures) -> DataFrame:
    return comments.unhandled_comments(fx.comments(), fx.seen(), fx.jobs()).select("comment_id", "login")


@query("pair_timings", """
SELECT job_id, pos, coalesce(max(dataset) FILTER (side = 'base'), max(dataset)) AS dataset,
       coalesce(max(duration_ms) FILTER (side = 'base'), 0.0) AS base_ms,
       coalesce(max(duration_ms) FILTER (side = 'head'), 0.0) AS head_ms
FROM fx_timings GROUP BY 1, 2
""")
def pair_timings(fx: Fixtures) -> DataFrame:
    return timings.pair_timings(fx.timings())


@query("attach_revisions", f"""
SELECT c.comment_id, c.repository, {ISSUE_NUMBER.replace('issue_url', 'c.issue_url')} AS number, p.html_url AS pull_request_url,
       p.base_sha, p.head_sha, p.base_sha IS NOT NULL AS found
FROM fx_comments c LEFT JOIN fx_pull_requests p
  ON p.repository = c.repository AND p.number = {ISSUE_NUMBER.replace('issue_url', 'c.issue_url')}
""")
def attach_revisions(fx: Fixtures) -> DataFrame:
    requests = fx.comments().select("comment_id", "repository", issue_number(F.col("issue_url")).alias("number"))
    return comments.attach_revisions(requests, fx.pull_requests())


@query("normal_vs_orphan_jobs", """
SELECT id, comment_id, status FROM fx_jobs j
WHERE NOT EXISTS (SELECT 1 FROM fx_comments c WHERE c.comment_id = j.comment_id AND c.comment_id % 13 = 0)
""")
def orphans(fx: Fixtures) -> DataFrame:
    return jobs.orphan_jobs(fx.jobs(), fx.seen()).select("id", "comment_id", "status")
