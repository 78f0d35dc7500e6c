"""A sample SQL corpus in the shape of the public TPC-H queries, and whole jobs."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, functions as F

from lapwise.contract.aggregates import TOTALS
from lapwise.contract.base import query
from lapwise.contract.joins import COMPARED
from lapwise.contract.ordering import pairs, report_jobs
from lapwise.contract.predicates import ELIGIBLE, sparse_jobs
from lapwise.contract.scans import manifest_entries
from lapwise.fixtures import Fixtures
from lapwise.plans import compare, suite
from lapwise.plans.comments import process_comments
from lapwise.plans.job_report import base_head_report
from lapwise.plans.settings import applied_settings
from lapwise.session import work_dir
from lapwise.sources.results import store_iterations
from lapwise.sources.tables import TABLES, register_tables, table_path

MONEY = "CAST({0} AS DECIMAL(15,2))"
_PRICE, _DISCOUNT = MONEY.format("l_extendedprice"), MONEY.format("l_discount")
REVENUE = f"CAST(sum({_PRICE} * (1 - {_DISCOUNT})) AS DOUBLE)"

CORPUS = {
    "q1": f"""
SELECT l_returnflag, l_linestatus, CAST(sum({MONEY.format('l_quantity')}) AS DOUBLE) AS sum_qty,
       CAST(sum({_PRICE}) AS DOUBLE) AS sum_base_price, {REVENUE} AS sum_disc_price,
       CAST(sum({_PRICE} * (1 - {_DISCOUNT}) * (1 + {MONEY.format('l_tax')})) AS DOUBLE) AS sum_charge,
       CAST(sum({MONEY.format('l_quantity')}) AS DOUBLE) / count(*) AS avg_qty,
       CAST(sum({_DISCOUNT}) AS DOUBLE) / count(*) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02'
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "q3": f"""
SELECT l_orderkey, {REVENUE} AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "q5": f"""
SELECT n_name, {REVENUE} AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01'
GROUP BY n_name ORDER BY revenue DESC""",
    "q6": f"""
SELECT CAST(sum({_PRICE} * {_DISCOUNT}) AS DOUBLE) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01'
  AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "q7": f"""
SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, {REVENUE} AS revenue
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey
JOIN nation n2 ON c_nationkey = n2.n_nationkey
WHERE (n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2' OR n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')
  AND l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '1997-01-01'
GROUP BY n1.n_name, n2.n_name, year(l_shipdate) ORDER BY supp_nation, cust_nation, l_year""",
    "q8": f"""
SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year,
       CAST(sum(CASE WHEN n2.n_name = 'NATION_3' THEN {_PRICE} * (1 - {_DISCOUNT}) ELSE 0 END) AS DOUBLE) / {REVENUE} AS mkt_share
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey
JOIN nation n2 ON s_nationkey = n2.n_nationkey
WHERE r_name = 'AMERICA' AND o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1997-01-01'
  AND p_type = 'ECONOMY' GROUP BY year(o_orderdate) ORDER BY o_year""",
    "q10": f"""
SELECT c_custkey, c_name, {REVENUE} AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= DATE '1997-10-01' AND o_orderdate < DATE '1998-01-01' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "q14": f"""
SELECT 100.0 * CAST(sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_PRICE} * (1 - {_DISCOUNT}) ELSE 0 END) AS DOUBLE) / {REVENUE} AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'""",
    "q15": f"""
CREATE VIEW revenue0 (supplier_no, total_revenue) AS
SELECT l_suppkey, {REVENUE} FROM lineitem
WHERE l_shipdate >= '1996-01-01' AND l_shipdate < date '1996-04-01' GROUP BY l_suppkey;
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue0 ON s_suppkey = supplier_no
WHERE total_revenue = (SELECT max(total_revenue) FROM revenue0) ORDER BY s_suppkey;
DROP VIEW revenue0;""",
    "q18": f"""
SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice,
       CAST(sum({MONEY.format('l_quantity')}) AS DOUBLE) AS quantity
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum({MONEY.format('l_quantity')}) > 200)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice
ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
}
Q15_SINGLE = f"""
WITH revenue0 AS (
  SELECT l_suppkey AS supplier_no, {REVENUE} AS total_revenue FROM lineitem
  WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue0 ON s_suppkey = supplier_no
WHERE total_revenue = (SELECT max(total_revenue) FROM revenue0) ORDER BY s_suppkey"""


# Reports in the shape of public decision-support queries: subtotals, ranks among siblings, running and range frames,
# and subqueries that have to become outer, semi and anti joins.
_BALANCE = MONEY.format("c_acctbal")
REPORTS = {
    "rollup": f"""
SELECT r_name, n_name, o_year, CAST(grouping(r_name) + grouping(n_name) + grouping(o_year) AS BIGINT) AS level,
       count(*) AS orders, count(DISTINCT o_custkey) AS customers, CAST(sum(price) AS DOUBLE) AS price
FROM (SELECT r_name, n_name, CAST(year(o_orderdate) AS BIGINT) AS o_year, o_custkey, {MONEY.format('o_totalprice')} AS price
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) o
GROUP BY ROLLUP (r_name, n_name, o_year) ORDER BY level, r_name, n_name, o_year""",
    "grouping_sets": f"""
SELECT p_brand, p_type, l_returnflag, level, revenue, CAST(rank() OVER (PARTITION BY level, CASE WHEN of_type = 0 THEN p_brand END ORDER BY revenue DESC) AS BIGINT) AS place
FROM (SELECT p_brand, p_type, l_returnflag, CAST(4 * grouping(p_brand) + 2 * grouping(p_type) + grouping(l_returnflag) AS BIGINT) AS level,
             grouping(p_type) AS of_type, {REVENUE} AS revenue
      FROM lineitem JOIN part ON l_partkey = p_partkey
      GROUP BY GROUPING SETS ((p_brand, p_type), (p_brand), (p_type, l_returnflag), (l_returnflag), ())) g
ORDER BY level, place, p_brand, p_type, l_returnflag""",
    "frames": f"""
WITH monthly AS (
  SELECT o_orderpriority, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS mon, count(*) AS n, sum({MONEY.format('o_totalprice')}) AS price
  FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority, year(o_orderdate) * 12 + month(o_orderdate))
SELECT o_orderpriority, mon, n, CAST(price AS DOUBLE) AS price,
       CAST(sum(price) OVER (PARTITION BY o_orderpriority ORDER BY mon ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running,
       CAST(sum(price) OVER (PARTITION BY o_orderpriority ORDER BY mon RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS quarter,
       CAST(sum(n) OVER (PARTITION BY o_orderpriority ORDER BY mon RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS around,
       max(n) OVER (PARTITION BY o_orderpriority ORDER BY mon ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS most_before,
       lag(n) OVER (PARTITION BY o_orderpriority ORDER BY mon) AS before, lead(n, 2) OVER (PARTITION BY o_orderpriority ORDER BY mon) AS after,
       CAST(ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY price, mon) AS BIGINT) AS quartile,
       first_value(mon) OVER (PARTITION BY o_orderpriority ORDER BY price DESC, mon) AS best_mon
FROM monthly ORDER BY o_orderpriority, mon""",
    "q13": """
SELECT c_count, count(*) AS custdist
FROM (SELECT c_custkey, count(o_orderkey) AS c_count
      FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%-NOT%' GROUP BY c_custkey) c
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "q17": f"""
SELECT CAST(sum({_PRICE}) AS DOUBLE) / 7.0 AS avg_yearly, count(*) AS lines
FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_type = 'MEDIUM' AND l_quantity * 5 < (
  SELECT CAST(sum({MONEY.format('i.l_quantity')}) AS DOUBLE) / count(*) FROM lineitem i WHERE i.l_partkey = p_partkey)""",
    "q22": f"""
SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS numcust, CAST(sum({_BALANCE}) AS DOUBLE) AS totacctbal
FROM customer
WHERE c_nationkey IN (1, 3, 5, 8, 13, 17, 21)
  AND c_acctbal > (SELECT CAST(sum({_BALANCE}) AS DOUBLE) / count(*) FROM customer WHERE c_acctbal > 0)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '1998-01-01')
GROUP BY c_nationkey ORDER BY c_nationkey""",
    "not_in": """
SELECT p_brand, p_type, count(DISTINCT l_suppkey) AS supplier_cnt
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_size IN (3, 9, 14, 19, 23, 36, 45, 49) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type ORDER BY supplier_cnt DESC, p_brand, p_type""",
    "set_operations": """
SELECT kind, o_custkey, count(*) AS times FROM (
  SELECT 'both' AS kind, o_custkey FROM (
    SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 INTERSECT ALL SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997) a
  UNION ALL
  SELECT 'more', o_custkey FROM (
    SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 EXCEPT ALL SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997) b
  UNION ALL
  SELECT 'never', c_custkey FROM (
    SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') c) u
GROUP BY kind, o_custkey""",
}


def _register(fx: Fixtures, *texts: str) -> None:
    """Register the tables that the texts name."""
    used = [t for t in TABLES if any(re.search(rf"\b{t}\b", text) for text in texts)]
    register_tables(fx.spark, {t: table_path(fx.sf_dir, t) for t in used})


def _as_text(sql: str) -> str:
    """Dates are compared as text."""
    return f"SELECT * REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate) FROM ({sql}) q" if "AS o_orderdate" in sql else sql


def _corpus_query(id: str, sql: str, group: str = "tpch") -> None:
    @query(f"{group}_{id}", _as_text(sql))
    def build(fx: Fixtures) -> DataFrame:
        _register(fx, sql)
        result = fx.spark.sql(suite.prepare(sql)[0])
        if "o_orderdate" in result.columns:
            result = result.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
        return result


for _id, _sql in CORPUS.items():
    if _id != "q15":
        _corpus_query(_id, _sql)
for _id, _sql in REPORTS.items():
    _corpus_query(_id, _sql, "tpch" if re.fullmatch(r"q\d+", _id) else "report")


@query("tpch_q15", Q15_SINGLE)
def tpch_q15(fx: Fixtures) -> DataFrame:
    """The view query: create, select, and the view stays only as long as the plan needs it."""
    _register(fx, CORPUS["q15"])
    create, select, drop = suite.prepare(CORPUS["q15"])
    fx.spark.sql(create)
    result = fx.spark.sql(select)
    fx.spark.sql(drop)
    return result


_COUNTS = " UNION ALL ".join(
    f"SELECT '{id}' AS id, (SELECT count(*) FROM ({Q15_SINGLE if id == 'q15' else sql}) c) AS row_count, false AS failed"
    for id, sql in (CORPUS | REPORTS).items()
)
_RUN_ORACLE = f"{_COUNTS} UNION ALL SELECT 'broken', 0, true"


@query("run_suite", _RUN_ORACLE)
def run_suite(fx: Fixtures) -> DataFrame:
    corpus = CORPUS | REPORTS
    _register(fx, *corpus.values())
    corpus = [*corpus.items(), ("broken", "SELECT no_such_column FROM lineitem")]
    measured = suite.run_suite(fx.spark, corpus, "tpch/made", "lapwise", iterations=1, warmup=False)
    return measured.select("id", "row_count", F.col("error").isNotNull().alias("failed"))


@query("run_view_query", f"SELECT count(*) AS row_count, true AS timed, true AS planned FROM ({Q15_SINGLE}) q")
def run_view_query(fx: Fixtures) -> DataFrame:
    _register(fx, CORPUS["q15"])
    measured = suite.run_suite(fx.spark, [("q15", CORPUS["q15"])], "tpch/made", "lapwise", iterations=1, warmup=True)
    return measured.select(
        "row_count", ((F.col("elapsed") > 0) & (F.col("tasks") > 0)).alias("timed"),
        F.col("plan").contains("Physical Plan").alias("planned"),
    )


@query("apply_settings", """
SELECT l_orderkey, count(*) AS lines, CAST(5 AS BIGINT) AS partitions, 'SortMergeJoin' AS join_type, '1048576' AS scan_bytes,
       'unsupported' AS partial_reduce
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey
""")
def settings_applied(fx: Fixtures) -> DataFrame:
    """A join and an aggregation executed under other settings, with what their execution shows of them."""
    _register(fx, "lineitem orders")
    path = work_dir(fx.spark, "settings")
    options = {
        "target_partitions": 5, "file_scan_config_bytes_per_partition": 1 << 20, "broadcast_joins": False,
        "dynamic_task_count": False, "partial_reduce": True,
    }
    with applied_settings(fx.spark, options) as report:
        sql = "SELECT l_orderkey, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey"
        plan = fx.spark.sql(f"EXPLAIN FORMATTED {sql}").head()[0]
        fx.spark.sql(sql).withColumn("partition", F.spark_partition_id()).write.parquet(path)
        scan_bytes = fx.spark.conf.get("spark.sql.files.maxPartitionBytes")
    joins = re.findall(r"SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin", plan)
    written = fx.spark.read.parquet(path)
    partitions = written.agg(F.countDistinct("partition").alias("partitions"))
    return written.drop("partition").crossJoin(F.broadcast(partitions)).select(
        "l_orderkey", "lines", "partitions", F.lit(joins[0]).alias("join_type"),
        F.lit(scan_bytes.rstrip("b")).alias("scan_bytes"), F.lit(report["partial_reduce"]).alias("partial_reduce"),
    )


# --- comparisons of stored runs -------------------------------------------------


@query("compare_stored", f"""
WITH {COMPARED}, {TOTALS}
SELECT *, factor >= 1.1 AND NOT isnan(factor) AS highlighted FROM judged
""")
def compare_stored(fx: Fixtures) -> DataFrame:
    # Without manifests a run is all its documents, and both sides hold the same queries.
    empty = manifest_entries(fx).where("false")
    return compare.compare_stored(fx.iteration_records(), empty, pairs(fx)).totals


_LISTED_TOTALS = TOTALS.replace("FROM compared)", "FROM compared WHERE id <> 'q7' AND dataset <> 'ev/view')")


@query("compare_bucketed", f"""
WITH {COMPARED}, {TOTALS}
SELECT *, factor >= 1.1 AND NOT isnan(factor) AS highlighted FROM judged
""")
def compare_bucketed(fx: Fixtures) -> DataFrame:
    """Two runs stored one after the other in a table whose rows of a query lie together."""
    table = f"stored_{uuid.uuid4().hex}"
    for engine in ("base", "head"):
        run = fx.iteration_records().where(F.col("engine") == engine)
        store_iterations(run, table, work_dir(fx.spark, "stored") if engine == "base" else None, buckets=8)
    compared = compare.compare_pairs(fx.spark.table(table), pairs(fx))
    fx.spark.sql(f"DROP TABLE {table}")  # the files stay
    return compared.totals


@query("compare_stored_sets", f"""
WITH {COMPARED}, {_LISTED_TOTALS} SELECT *, factor >= 1.1 AND NOT isnan(factor) AS highlighted FROM judged
""")
def compare_stored_sets(fx: Fixtures) -> DataFrame:
    """With manifests: stale documents are not compared, and a dataset whose sets differ is left out."""
    manifests = manifest_entries(fx, "id <> 'q7'")
    compared = compare.compare_stored(fx.iteration_records(), manifests, pairs(fx), strict=False)
    return compared.totals


@query("compare_with_previous", f"""
WITH {COMPARED}, {TOTALS} SELECT *, factor >= 1.1 AND NOT isnan(factor) AS highlighted FROM judged
""")
def compare_with_previous(fx: Fixtures) -> DataFrame:
    iterations = fx.iteration_records()
    base = iterations.where("engine = 'base'")
    manifests = manifest_entries(fx, "engine = 'base' AND id <> 'q99'")
    new = iterations.where("engine = 'head'")
    return compare.compare_with_previous(base, manifests, new, "head").totals


@query("base_head_report", f"""
WITH {COMPARED}, {TOTALS},
jobs AS (SELECT o_orderkey AS job_id, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [0, 2] ELSE [4, 1, 3] END) AS n FROM orders),
requested AS (SELECT job_id, 'ev/' || ['click', 'error', 'purchase', 'signup', 'view'][(job_id + n) % 5 + 1] AS dataset FROM jobs),
summed AS (SELECT job_id, count(*) AS datasets, CAST(sum(compared) AS BIGINT) AS queries, CAST(sum(prev_time) AS BIGINT) AS prev_time,
                  CAST(sum(new_time) AS BIGINT) AS new_time, count(*) FILTER (direction = 'faster') AS faster,
                  count(*) FILTER (factor >= 1.1 AND NOT isnan(factor)) AS highlighted
           FROM requested r JOIN judged j ON j.dataset = r.dataset GROUP BY 1),
phases AS (SELECT l_orderkey AS job_id, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,3))) FILTER (l_linestatus = 'O'), 0) AS DOUBLE) AS base_ms,
                  CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,3))) FILTER (l_linestatus <> 'O'), 0) AS DOUBLE) AS head_ms, count(*) AS phases
           FROM lineitem GROUP BY 1)
SELECT s.*, coalesce(base_ms, 0.0) AS base_ms, coalesce(head_ms, 0.0) AS head_ms, coalesce(phases, 0) AS phases
FROM summed s LEFT JOIN phases p ON p.job_id = s.job_id
""")
def report_of_jobs(fx: Fixtures) -> DataFrame:
    return base_head_report(report_jobs(fx), compare.compare_pairs(fx.iteration_records(), pairs(fx)), fx.timings())


PROCESSED = f"""eligible AS ({ELIGIBLE}),
looked AS (SELECT e.*, p.base_sha FROM eligible e LEFT JOIN fx_pull_requests p ON p.repository = e.repository AND p.number = e.number),
staged AS (SELECT *, CASE WHEN outcome <> 'candidate' THEN outcome WHEN base_sha IS NULL THEN 'retry' ELSE 'request' END AS stage FROM looked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY queue, login ORDER BY updated_at, comment_id) AS r FROM staged WHERE stage = 'request'),
counted AS (SELECT *, coalesce(sum(CASE WHEN r <= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY queue ORDER BY updated_at, comment_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked),
final AS (SELECT s.*, CASE WHEN s.stage <> 'request' THEN s.stage WHEN c.before >= 20 THEN 'queue_full' WHEN c.r > 3 THEN 'requester_limit'
               ELSE 'queued' END AS decided FROM staged s LEFT JOIN counted c ON c.comment_id = s.comment_id)"""
_REPLY = """CASE decided WHEN 'invalid_reply' THEN '@' || login || ' ' || message
  WHEN 'queue_full' THEN '@' || login || ' The benchmark queue is full; this request was not queued.'
  WHEN 'requester_limit' THEN '@' || login || ' The requester already has three active jobs; this request was not queued.' END"""


@query("process_comments", f"""
WITH {PROCESSED}
SELECT comment_id, decided AS outcome, {_REPLY} AS reply, decided NOT IN ('retry', 'status_comment') AS settled,
       CASE WHEN decided = 'retry' THEN CAST(1 AS BIGINT) END AS attempt FROM final
""")
def process(fx: Fixtures) -> DataFrame:
    outcomes = process_comments(
        fx.comments(), fx.seen(), sparse_jobs(fx), fx.allow_list(), fx.pull_requests(),
        fx.spark.createDataFrame([], "queue bigint, requested_by string, active bigint"),
        fx.spark.createDataFrame([], "comment_id bigint, attempts bigint, next_attempt_at timestamp"),
        F.lit("2024-02-01 00:00:00").cast("timestamp"),
    )
    return outcomes.select("comment_id", "outcome", "reply", "settled", "attempt")
