"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapwise.contract.base import query
from lapwise.fixtures import Fixtures
from lapwise.functions import names
from lapwise.functions.commands import parse_commands
from lapwise.operators import catalog
from lapwise.operators.comments import admission_eligible
from lapwise.operators.iterations import successful_iterations
from lapwise.plans.settings import setting_statements

# Dataset-like names of every shape, made from the orders.
DATASET_NAMES = """SELECT o_orderkey AS id, CASE o_orderkey % 9
    WHEN 0 THEN 'tpch/sf' || CAST(o_custkey AS STRING) WHEN 1 THEN '../..' WHEN 2 THEN './sf1' WHEN 3 THEN 'tpch/..'
    WHEN 4 THEN 'tpch_sf1' WHEN 5 THEN 'a/b/' || CAST(o_custkey AS STRING) WHEN 6 THEN 'tpch/.' WHEN 7 THEN 'x y/sf1'
    ELSE 'clickbench/0-' || CAST(o_custkey AS STRING) END AS dataset FROM orders"""
_SHAPE = "regexp_full_match(dataset, '[a-zA-Z0-9._-]+/[a-zA-Z0-9._-]+')"


def _names(fx: Fixtures) -> DataFrame:
    return fx._sql(DATASET_NAMES)


@query("dataset_parts", f"""
SELECT id, split_part(dataset, '/', 1) AS suite, split_part(dataset, '/', 2) AS variant
FROM ({DATASET_NAMES}) n
WHERE {_SHAPE} AND split_part(dataset, '/', 1) NOT IN ('.', '..') AND split_part(dataset, '/', 2) NOT IN ('.', '..')
""")
def dataset_parts(fx: Fixtures) -> DataFrame:
    dataset = F.col("dataset")
    return _names(fx).where(names.is_dataset(dataset)).select(
        "id", names.suite_of(dataset).alias("suite"), names.variant_of(dataset).alias("variant")
    )


@query("safe_dataset", f"""
SELECT id, dataset, {_SHAPE} AND split_part(dataset, '/', 1) <> '..' AND split_part(dataset, '/', 2) <> '..'
       AND dataset <> './.' AS safe
FROM ({DATASET_NAMES}) n
""")
def safe_dataset(fx: Fixtures) -> DataFrame:
    return _names(fx).select("id", "dataset", names.is_below_root(F.col("dataset")).alias("safe"))


USAGE = "Expected `benchmarks run <suite>/<variant>... [--instance-type <type>] [--nodes <count>]`."
# The fixture holds one comment per branch of the grammar, so the expected
# results are stated by branch.
EXPECTED_COMMANDS = f"""SELECT c.*, e.kind, e.message, e.datasets, e.instance_type, e.nodes FROM fx_comments c JOIN (VALUES
  (0, 'request', NULL, 'tpch/sf1', 'c5n.2xlarge', 12), (1, 'request', NULL, 'tpch/sf1,tpch/sf10', 'c5n.2xlarge', 6),
  (2, 'request', NULL, 'tpch/sf1', 'c7i.2xlarge', 4),
  (3, 'invalid', 'Invalid dataset `tpch_sf1`; expected a path such as `tpch/sf1`.', NULL, NULL, NULL),
  (4, 'invalid', 'Each dataset may be requested only once.', NULL, NULL, NULL),
  (5, 'invalid', 'Invalid node count `25`; expected an integer from 1 to 24.', NULL, NULL, NULL),
  (6, 'invalid', 'Invalid node count `1.5`; expected an integer from 1 to 24.', NULL, NULL, NULL),
  (7, 'invalid', '{USAGE}', NULL, NULL, NULL), (8, 'invalid', '{USAGE}', NULL, NULL, NULL),
  (9, 'invalid', 'Invalid instance type `BAD`.', NULL, NULL, NULL),
  (10, 'request', NULL, 'clickbench/0-100', 'c5n.2xlarge', 12), (11, 'none', NULL, NULL, NULL, NULL)
) e(branch, kind, message, datasets, instance_type, nodes) ON c.comment_id % 12 = e.branch"""


@query("parse_commands", f"""
SELECT comment_id, kind, message, datasets, instance_type, CAST(nodes AS BIGINT) AS nodes FROM ({EXPECTED_COMMANDS}) p
""")
def parse(fx: Fixtures) -> DataFrame:
    parsed = parse_commands(fx.comments())
    return parsed.select(
        "comment_id", "kind", "message", F.array_join("datasets", ",").alias("datasets"), "instance_type", "nodes"
    )


ISSUE_NUMBER = "nullif(TRY_CAST(nullif(regexp_extract(issue_url, '/issues/([0-9]+)$', 1), '') AS BIGINT), 0)"


@query("issue_number", f"SELECT comment_id, {ISSUE_NUMBER} AS number FROM fx_comments")
def issue_number(fx: Fixtures) -> DataFrame:
    return fx.comments().select("comment_id", names.issue_number(F.col("issue_url")).alias("number"))


_LABEL = "coalesce(nullif(string_split(trim(branch), '/')[-1], ''), substr(commit_sha, 1, 12))"


@query("run_label", f"SELECT worktree_id, {_LABEL} AS label FROM fx_branches")
def run_label(fx: Fixtures) -> DataFrame:
    return fx.branches().select("worktree_id", names.run_label(F.col("branch"), F.col("commit_sha")).alias("label"))


@query("label_collisions", f"""
SELECT {_LABEL} AS label, count(DISTINCT branch) AS branches FROM fx_branches WHERE branch IS NOT NULL
GROUP BY 1 HAVING count(DISTINCT branch) > 1
""")
def label_collisions(fx: Fixtures) -> DataFrame:
    label = names.run_label(F.col("branch"), F.col("commit_sha"))
    return catalog.label_collisions(fx.branches().withColumn("label", label))


@query("valid_sha", """
SELECT worktree_id, regexp_full_match(sha, '[0-9a-f]{40}') AS valid
FROM (SELECT worktree_id, CASE worktree_id % 4 WHEN 0 THEN upper(commit_sha) WHEN 1 THEN substr(commit_sha, 1, 39)
             ELSE commit_sha END AS sha FROM fx_branches) b
""")
def valid_sha(fx: Fixtures) -> DataFrame:
    sha = (
        F.when(F.col("worktree_id") % 4 == 0, F.upper("commit_sha"))
        .when(F.col("worktree_id") % 4 == 1, F.left("commit_sha", F.lit(39)))
        .otherwise(F.col("commit_sha"))
    )
    return fx.branches().select("worktree_id", names.is_sha(sha).alias("valid"))


# One request per order line of a customer: some lists, some absent.
_REQUESTS = """SELECT o_orderkey AS request_id,
    CASE o_orderkey % 5 WHEN 0 THEN 'ev/click' WHEN 1 THEN 'ev/view' WHEN 2 THEN 'ev/error' WHEN 3 THEN 'ev/signup' ELSE 'ev/purchase' END AS dataset,
    CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'q1, q3 ,custom' WHEN 2 THEN ' q2,,q2 ' ELSE 'q' || CAST(o_custkey % 40 AS STRING) END AS request
    FROM orders"""


@query("select_queries", f"""
WITH q AS (SELECT DISTINCT dataset, id FROM fx_iterations),
r AS (SELECT request_id, dataset, request FROM ({_REQUESTS}) x),
wanted AS (SELECT DISTINCT request_id, dataset, trim(u.id) AS id
           FROM r, unnest(string_split(request, ',')) AS u(id) WHERE trim(u.id) <> '')
SELECT w.request_id, w.dataset, w.id FROM wanted w JOIN q ON w.dataset = q.dataset AND w.id = q.id
UNION ALL SELECT r.request_id, r.dataset, q.id FROM r JOIN q ON r.dataset = q.dataset WHERE r.request IS NULL
""")
def select_queries(fx: Fixtures) -> DataFrame:
    return catalog.select_queries(fx.iteration_records(), fx._sql(_REQUESTS), ["request_id"])


@query("settings", """
SELECT p_partkey AS id, concat_ws(chr(10),
         'SET batch_size=' || CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS VARCHAR) END || ';',
         'SET compression=' || CASE WHEN p_partkey % 4 = 0 THEN 'zstd' WHEN p_partkey % 4 = 1 THEN 'lz4' END || ';',
         'SET broadcast_joins=' || CASE WHEN p_partkey % 5 = 0 THEN 'false' WHEN p_partkey % 5 = 1 THEN 'true' END || ';',
         'SET max_tasks_per_stage=' || CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 3 AS VARCHAR) END || ';') AS statements
FROM part
""")
def settings(fx: Fixtures) -> DataFrame:
    key = F.col("p_partkey")
    options = {
        "max_tasks_per_stage": F.when(key % 2 == 0, key % 3),
        "batch_size": F.when(key % 3 != 0, F.col("p_size")),
        "compression": F.when(key % 4 == 0, "zstd").when(key % 4 == 1, "lz4"),
        "broadcast_joins": F.when(key % 5 == 0, False).when(key % 5 == 1, True),
    }
    return fx.table("part").select(key.alias("id"), setting_statements(options).alias("statements"))


@query("successful_iterations", """
SELECT dataset, engine, id, count(*) AS iterations, round(sum(CAST(elapsed AS DECIMAL(12,2))), 2)::DOUBLE AS elapsed
FROM fx_iterations WHERE coalesce(error, '') = '' GROUP BY 1, 2, 3
""")
def successful(fx: Fixtures) -> DataFrame:
    return successful_iterations(fx.iteration_records()).groupBy("dataset", "engine", "id").agg(
        F.count(F.lit(1)).alias("iterations"),
        F.sum(F.col("elapsed").cast("decimal(12,2)")).cast("double").alias("elapsed"),
    )


@query("bucket_uri", """
SELECT o_orderkey AS id, 's3://' || regexp_replace(regexp_replace(b, '^s3://', ''), '/+$', '') AS uri,
       's3a://' || regexp_replace(regexp_replace(b, '^s3://', ''), '/+$', '') AS hadoop_uri
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 's3://' ELSE '' END || 'lab-' || CAST(o_custkey AS VARCHAR)
             || CASE o_orderkey % 4 WHEN 0 THEN '/' WHEN 1 THEN '//' ELSE '' END AS b FROM orders) t
""")
def bucket_uri(fx: Fixtures) -> DataFrame:
    key = F.col("o_orderkey")
    bucket = F.concat(
        F.when(key % 3 == 0, "s3://").otherwise(""), F.lit("lab-"), F.col("o_custkey").cast("string"),
        F.when(key % 4 == 0, "/").when(key % 4 == 1, "//").otherwise(""),
    )
    uri = names.bucket_uri(bucket)
    return fx.table("orders").select(key.alias("id"), uri.alias("uri"), names.hadoop_uri(uri).alias("hadoop_uri"))


ELIGIBLE = f"""SELECT p.*, {ISSUE_NUMBER} AS number,
       CASE WHEN j.comment_id IS NOT NULL AND j.status_comment_id IS NULL THEN 'status_comment'
            WHEN p.comment_id % 13 = 0 OR j.comment_id IS NOT NULL THEN 'handled'
            WHEN kind = 'none' THEN 'ignored_none'
            WHEN {ISSUE_NUMBER} IS NULL THEN 'ignored_not_pr'
            WHEN TRY_CAST(regexp_extract(lower(login), '^user([0-9]+)$', 1) AS INT) IS NULL
              OR TRY_CAST(regexp_extract(lower(login), '^user([0-9]+)$', 1) AS INT) >= 25 THEN 'ignored_unauthorised'
            WHEN kind = 'invalid' THEN 'invalid_reply' ELSE 'candidate' END AS outcome
FROM ({EXPECTED_COMMANDS}) p LEFT JOIN (SELECT 5 * id AS comment_id, status_comment_id FROM fx_jobs) j ON j.comment_id = p.comment_id"""


def sparse_jobs(fx: Fixtures) -> DataFrame:
    """All jobs, spread over every fifth comment, so that the others have none."""
    return fx.jobs().withColumn("comment_id", 5 * F.col("id"))


@query("admission_eligible", f"SELECT comment_id, outcome, number FROM ({ELIGIBLE}) e")
def eligible(fx: Fixtures) -> DataFrame:
    return admission_eligible(fx.comments(), fx.seen(), sparse_jobs(fx), fx.allow_list()).select("comment_id", "outcome", "number")
