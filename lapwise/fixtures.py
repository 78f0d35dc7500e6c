"""Record-shaped views over the supplied tables.

Each view gives one supplied table the record shape of a benchmark platform:
iterations, comments, jobs, listings and so on.  The texts run unchanged on
Spark and on other SQL engines, so a result can be checked against both.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lapwise.operators.numbering import number_rows
from lapwise.sources.tables import TABLES, read_table

# Iterations without their number; ``seq`` and ``started_at`` order them.
ITERATION_RECORDS = """
SELECT dataset, engine, id, ts AS started_at, event_id AS seq,
       CASE WHEN error = 'executor lost' THEN 0.0 ELSE value END AS elapsed,
       CASE WHEN error = 'executor lost' THEN 0 ELSE event_id % 100 END AS row_count,
       CASE WHEN error = 'executor lost' THEN 0 ELSE k END AS tasks,
       CASE WHEN k % 3 <> 0 THEN 1.0 + k / 10.0 END AS stats_q_error_p50,
       CASE WHEN k % 3 <> 0 THEN 2.0 + k / 5.0 END AS stats_q_error_p95,
       error
FROM (SELECT 'ev/' || event_type AS dataset,
             CASE WHEN event_id % 2 = 0 THEN 'base' ELSE 'head' END AS engine,
             CASE user_id % 23 WHEN 0 THEN 'custom' WHEN 21 THEN 'Alpha' WHEN 22 THEN 'q1b'
                  ELSE 'q' || CAST(user_id % 23 AS STRING) END AS id,
             ts, event_id, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
             CASE WHEN event_id % 499 = 0 THEN 'executor lost' WHEN event_id % 499 = 1 THEN '' END AS error
      FROM events) t
"""

ITERATIONS = f"""
SELECT dataset, engine, id,
       row_number() OVER (PARTITION BY dataset, engine, id ORDER BY started_at, seq) - 1 AS iteration,
       elapsed, row_count, tasks, stats_q_error_p50, stats_q_error_p95, error
FROM ({ITERATION_RECORDS}) r
"""

COMMENTS = """
SELECT event_id AS comment_id, 'o/r' || CAST(user_id % 3 AS STRING) AS repository,
       CAST(floor(event_id / 250) AS BIGINT) AS queue, event_id % 211 <> 0 AS settled,
       CASE WHEN event_id % 7 = 0 THEN 'Stranger' ELSE 'User' || CAST(user_id % 29 AS STRING) END AS login,
       CASE WHEN event_id % 31 = 0 THEN 'https://api.example.org/repos/o/r/pulls/'
            ELSE 'https://api.example.org/repos/o/r/issues/' END || CAST(user_id AS STRING) AS issue_url,
       CASE event_id % 12
         WHEN 0 THEN 'benchmarks run tpch/sf1'
         WHEN 1 THEN 'benchmarks run tpch/sf1 tpch/sf10 --nodes 6'
         WHEN 2 THEN 'benchmarks run tpch/sf1 --nodes 4 --instance-type c7i.2xlarge'
         WHEN 3 THEN 'benchmarks run tpch_sf1'
         WHEN 4 THEN 'benchmarks run tpch/sf1 tpch/sf1'
         WHEN 5 THEN 'benchmarks run tpch/sf1 --nodes 25'
         WHEN 6 THEN 'benchmarks run tpch/sf1 --nodes 1.5'
         WHEN 7 THEN 'benchmarks run tpch/sf1 --nodes 12 now'
         WHEN 8 THEN 'benchmarks run'
         WHEN 9 THEN 'benchmarks run a/b --instance-type BAD'
         WHEN 10 THEN '  benchmarks   run  clickbench/0-100  '
         ELSE 'looks good' END AS body,
       ts AS created_at, ts AS updated_at
FROM events
"""

JOBS = """
SELECT o_orderkey AS id, o_orderkey AS comment_id,
       'User' || CAST(o_custkey % 50 AS STRING) AS requested_by,
       'tpch/sf1' AS dataset,
       CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'not-json' WHEN 2 THEN '[]'
            WHEN 3 THEN '{"a":1}' WHEN 4 THEN '["tpch/sf1",1]' WHEN 5 THEN '["tpch/sf1",null]'
            ELSE '["tpch/sf1","tpcds/sf10"]' END AS datasets_json,
       CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running'
            ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'completed' END END AS status,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey + 1000000 END AS status_comment_id,
       o_orderkey % 5 AS attempt_count,
       o_orderdate AS created_at, o_totalprice AS total_ms
FROM orders
"""

STATEMENT_PAGES = """
SELECT conv_id AS statement_id, turn AS page,
       CASE WHEN role = 'assistant' THEN
            CASE WHEN turn % 4 = 3 THEN 'Fragment 0' ELSE 'Output [x] ' || CAST(length(text) AS STRING) || ' rows' END
       END AS plan,
       CASE WHEN role = 'user' THEN length(text) % 50 END AS data_rows,
       CASE WHEN turn % 3 <> 2 THEN conv_id + turn * 10 END AS elapsed_ms
FROM conversations
"""

def _listing_path(part: str) -> str:
    """Paths of a listing; ``part`` names the files, so that two listings differ by names and not by left-out rows."""
    return f"""CASE o_custkey % 4 WHEN 0 THEN 'tpch' WHEN 1 THEN 'tpcds' WHEN 2 THEN 'clickbench' ELSE 'adhoc' END
       || CASE WHEN o_orderkey % 50 = 0 AND o_custkey % 4 <> 3 THEN '/queries/q' || CAST(o_orderkey AS STRING) || '.sql'
               ELSE '/sf' || CAST(o_orderkey % 3 AS STRING) || '/t' || CAST(o_custkey % 20 AS STRING) || '/part-' || {part} || CAST(o_orderkey AS STRING)
                    || CASE WHEN o_custkey % 20 IN (3, 6) AND o_orderkey % 11 = 0 THEN '.csv' ELSE '.parquet' END END"""

LISTING_SOURCE = f"""
SELECT o_orderkey % 2 AS root_idx, {_listing_path("CASE WHEN o_orderkey % 10 = 0 THEN 'new-' ELSE '' END")} AS path,
       o_custkey AS size, o_orderdate AS modified_at
FROM orders
"""

LISTING_TARGET = f"""
SELECT {_listing_path("CASE WHEN o_orderkey % 9 = 0 THEN 'old-' ELSE '' END")} AS path,
       o_custkey + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS size, o_orderdate AS modified_at
FROM orders
"""

JOB_EVENTS = """
SELECT user_id AS job_id, event_id, ts AS event_ts,
       CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'claim' WHEN 'view' THEN 'progress'
            WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS event,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS step
FROM events
"""

TIMING_RECORDS = """
SELECT l_orderkey AS job_id, CASE WHEN l_linestatus = 'O' THEN 'base' ELSE 'head' END AS side,
       l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax,
       'tpch/sf' || CAST(l_linenumber AS STRING) AS dataset, l_extendedprice AS duration_ms
FROM lineitem
"""

TIMINGS = f"""
SELECT job_id, side,
       row_number() OVER (PARTITION BY job_id, side
                          ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax) - 1 AS pos,
       dataset, duration_ms
FROM ({TIMING_RECORDS}) r
"""

MANIFESTS = f"""
SELECT DISTINCT dataset, engine, id,
       CASE WHEN engine = 'base' THEN 100 ELSE 200 END AS stored_at
FROM ({ITERATION_RECORDS}) i
WHERE NOT (engine = 'head' AND id = 'q7')
UNION ALL
SELECT 'ev/view', 'base', 'q99', 100
"""

BRANCHES = """
SELECT p_partkey AS worktree_id,
       CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_type WHEN 2 THEN 'feature/' || p_type ELSE 'a/b/' || p_brand END AS branch,
       substring(md5(CAST(p_partkey AS STRING)) || md5(p_name), 1, 40) AS commit_sha
FROM part
"""

# Pull requests by number; some have numbers that no comment names, so that look-ups fail.
PULL_REQUESTS = """
SELECT repository, number, 'https://example.org/' || repository || '/pull/' || CAST(number AS STRING) AS html_url,
       substring(md5('b' || CAST(number AS STRING)) || md5(c_name), 1, 40) AS base_sha,
       substring(md5('h' || CAST(number AS STRING)) || md5(c_name), 1, 40) AS head_sha
FROM (SELECT 'o/r' || CAST(c_custkey % 3 AS STRING) AS repository,
             CASE WHEN c_custkey % 17 = 0 THEN -1 - c_custkey ELSE c_custkey END AS number, c_name
      FROM customer) t
"""

# Failed attempts to handle a comment, with long error texts.
FAILURES = """
SELECT doc_id % 97 AS comment_id, doc_id AS failure_id,
       TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS failed_at,
       text AS error
FROM documents
"""

# Benchmark query texts with date literals, epoch functions, views and terminators.
SQL_TEXTS = """
SELECT o_orderkey AS id, CASE o_orderkey % 6
         WHEN 0 THEN 'select count(*) from orders where o_orderdate >= ''' || d || ''' and o_custkey = ' || c || ';'
         WHEN 1 THEN 'select * from orders where o_orderdate < date ''' || d || ''' or o_orderdate > DATE  ''1997-01-01'';;'
         WHEN 2 THEN '  select to_timestamp_seconds(' || c || '), TO_TIMESTAMP_SECONDS(x) from t;  '
         WHEN 3 THEN 'create view revenue0 (supplier_no, total_revenue) as  select l_suppkey, '
                     || 'sum(l_extendedprice * (1 - l_discount)) from lineitem where l_shipdate >= ''' || d
                     || ''' group by l_suppkey; select * from revenue0 where supplier_no = ' || c || ' ;; drop view revenue0;'
         WHEN 4 THEN 'Create  Or Replace  View v' || c || ' as select 1; CREATE OR REPLACE VIEW w as select 2'
         ELSE 'select ' || c END AS sql
FROM (SELECT o_orderkey, substring(CAST(o_orderdate AS STRING), 1, 10) AS d, CAST(o_custkey AS STRING) AS c FROM orders) t
"""


def _columns(df: DataFrame, **types: str) -> DataFrame:
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in types.items()])


class Fixtures:
    """The record-shaped views of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def _sql(self, text: str) -> DataFrame:
        for name in TABLES:
            if re.search(rf"FROM {name}\b", text):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def iteration_records(self) -> DataFrame:
        return _columns(
            self._sql(ITERATION_RECORDS),
            dataset="string", engine="string", id="string", started_at="timestamp", seq="bigint",
            elapsed="double", row_count="bigint", tasks="bigint",
            stats_q_error_p50="double", stats_q_error_p95="double", error="string",
        )

    def iterations(self) -> DataFrame:
        """Numbered iterations; use the records where the number is not read."""
        return number_rows(
            self.iteration_records(),
            keys=["dataset", "engine", "id"],
            slices=[minute("started_at")],
            order=["started_at", "seq"],
            name="iteration",
            start=0,
        ).select(
            "dataset", "engine", "id", "iteration", "elapsed", "row_count", "tasks",
            "stats_q_error_p50", "stats_q_error_p95", "error",
        )

    def comments(self) -> DataFrame:
        return _columns(
            self._sql(COMMENTS),
            comment_id="bigint", repository="string", queue="bigint", settled="boolean", login="string",
            issue_url="string", body="string", created_at="timestamp", updated_at="timestamp",
        )

    def jobs(self) -> DataFrame:
        return _columns(
            self._sql(JOBS),
            id="bigint", comment_id="bigint", requested_by="string", dataset="string", datasets_json="string",
            status="string", status_comment_id="bigint", attempt_count="bigint", created_at="timestamp",
            total_ms="double",
        )

    def statement_pages(self) -> DataFrame:
        return _columns(
            self._sql(STATEMENT_PAGES),
            statement_id="bigint", page="bigint", plan="string", data_rows="bigint", elapsed_ms="bigint",
        )

    def listing_source(self) -> DataFrame:
        return _columns(
            self._sql(LISTING_SOURCE), root_idx="bigint", path="string", size="bigint", modified_at="timestamp"
        )

    def listing_target(self) -> DataFrame:
        return _columns(self._sql(LISTING_TARGET), path="string", size="bigint", modified_at="timestamp")

    def job_events(self) -> DataFrame:
        return _columns(
            self._sql(JOB_EVENTS),
            job_id="bigint", event_id="bigint", event_ts="timestamp", event="string", step="bigint",
        )

    def timings(self) -> DataFrame:
        # A job has a few timings a side.  Dealt by job once, they are numbered and added up where they lie.
        return number_rows(
            self._sql(TIMING_RECORDS).repartition("job_id"),
            keys=["job_id", "side"],
            slices=[],
            order=["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax"],
            name="pos",
            start=0,
        ).select("job_id", "side", "pos", "dataset", F.col("duration_ms").cast("double").alias("duration_ms"))

    def manifests(self) -> DataFrame:
        return _columns(self._sql(MANIFESTS), dataset="string", engine="string", id="string", stored_at="bigint")

    def branches(self) -> DataFrame:
        return _columns(self._sql(BRANCHES), worktree_id="bigint", branch="string", commit_sha="string")

    def pull_requests(self) -> DataFrame:
        return _columns(
            self._sql(PULL_REQUESTS),
            repository="string", number="bigint", html_url="string", base_sha="string", head_sha="string",
        )

    def failures(self) -> DataFrame:
        return _columns(
            self._sql(FAILURES), comment_id="bigint", failure_id="bigint", failed_at="timestamp", error="string"
        )

    def sql_texts(self) -> DataFrame:
        return _columns(self._sql(SQL_TEXTS), id="bigint", sql="string")

    def allow_list(self) -> DataFrame:
        """Allowed logins, derived from the logins that occur."""
        return (
            self.comments()
            .select(F.lower("login").alias("login"))
            .where(F.regexp_extract("login", "^user([0-9]+)$", 1).try_cast("int") < 25)
            .distinct()
        )

    def seen(self) -> DataFrame:
        return self.comments().where(F.col("comment_id") % 13 == 0).select("comment_id")


def minute(column: str) -> Column:
    """Time slice for numbering: one query is measured serially, so a minute of one run stays small."""
    return F.date_trunc("minute", F.col(column))
