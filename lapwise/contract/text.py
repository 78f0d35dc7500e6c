"""Text, JSON and report functions over whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapwise.contract.aggregates import LINES
from lapwise.contract.base import query
from lapwise.contract.ordering import pairs, report_jobs
from lapwise.contract.predicates import EXPECTED_COMMANDS
from lapwise.contract.scans import NATURAL
from lapwise.fixtures import Fixtures
from lapwise.functions import names, sqltext, text
from lapwise.functions.commands import parse_commands
from lapwise.operators import jobs, report, statements
from lapwise.plans.compare import compare_pairs
from lapwise.plans.job_report import job_comparisons, result_reports
from lapwise.session import work_dir
from lapwise.sources.sinks import write_report

SITE = "https://example.org"


@query("pad_start", "SELECT p_partkey AS id, CASE WHEN length(p_name) >= 10 THEN p_name ELSE lpad(p_name, 10, ' ') END AS padded FROM part")
def pad_start(fx: Fixtures) -> DataFrame:
    return fx.table("part").select(F.col("p_partkey").alias("id"), text.pad_start(F.col("p_name"), 10).alias("padded"))


@query("format_duration", """
SELECT id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's'
            ELSE (s // 3600) || 'h ' || (s // 60 % 60) || 'm ' || (s % 60) || 's' END AS duration
FROM (SELECT id, greatest(0, CAST(floor((total_ms * CASE WHEN id % 3 = 0 THEN 40.0 ELSE 1.0 END - 20000) / 1000 + 0.5) AS BIGINT)) AS s FROM fx_jobs) j
""")
def format_duration(fx: Fixtures) -> DataFrame:
    factor = F.when(F.col("id") % 3 == 0, 40.0).otherwise(1.0)
    return fx.jobs().select("id", text.format_duration(F.col("total_ms") * factor - 20000).alias("duration"))


@query("html_escape", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def html_escape(fx: Fixtures) -> DataFrame:
    return fx.table("pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


_NOTICE = "'... earlier output truncated' || chr(10)"


@query("truncate_tail", f"""
SELECT doc_id, CASE WHEN length(text) <= n THEN text WHEN n <= 29 THEN substr({_NOTICE}, 1, n)
                    ELSE {_NOTICE} || right(text, n - 29) END AS tail
FROM (SELECT doc_id, text, CAST(CASE WHEN doc_id % 3 = 0 THEN doc_id % 40 ELSE 200 + doc_id % 500 END AS INTEGER) AS n FROM documents) d
""")
def truncate_tail(fx: Fixtures) -> DataFrame:
    key = F.col("doc_id")
    limit = F.when(key % 3 == 0, key % 40).otherwise(200 + key % 500).cast("int")
    return fx.table("documents").select("doc_id", text.truncate_tail(F.col("text"), limit).alias("tail"))


@query("utf8_tail", r"""
WITH b AS (SELECT doc_id, text, encode(text) AS data FROM documents),
h AS (SELECT doc_id, text, octet_length(data) AS n, substr(hex(data), 2 * greatest(octet_length(data) - 301, 0) + 1) AS tail FROM b)
SELECT doc_id, CASE WHEN n <= 301 THEN text
                    ELSE decode(unhex(regexp_replace(tail, '^((8|9|A|B)[0-9A-F])+', ''))) END AS tail
FROM h
""")
def utf8_tail(fx: Fixtures) -> DataFrame:
    return fx.table("documents").select("doc_id", text.utf8_tail(F.col("text"), 301).alias("tail"))


def _rewrite(name: str, function, sql: str) -> None:
    @query(name, f"SELECT id, {sql} AS sql FROM fx_sql_texts")
    def build(fx: Fixtures) -> DataFrame:
        return fx.sql_texts().select("id", function(F.col("sql")).alias("sql"))


_DATE = "'[0-9]{4}-[0-9]{2}-[0-9]{2}'".replace("'", "''")
_rewrite("rewrite_date_literals", sqltext.date_literals,
         f"regexp_replace(regexp_replace(sql, 'date\\s+({_DATE})', '\\1', 'gi'), '({_DATE})', 'DATE \\1', 'g')")
_rewrite("rewrite_epoch_fn", sqltext.epoch_function,
         "regexp_replace(sql, 'to_timestamp_seconds\\(', 'timestamp_seconds(', 'gi')")
_rewrite("rewrite_view_columns", sqltext.view_columns,
         "regexp_replace(sql, 'create view revenue0 \\(supplier_no, total_revenue\\) as\\s+select\\s+l_suppkey,"
         "\\s+sum\\(l_extendedprice \\* \\(1 - l_discount\\)\\)', "
         "'create view revenue0 as select l_suppkey as supplier_no, sum(l_extendedprice * (1 - l_discount)) as total_revenue', 'is')")
_rewrite("rewrite_temp_view", sqltext.temporary_view,
         "regexp_replace(sql, 'create\\s+(or\\s+replace\\s+)?view\\s+', 'CREATE OR REPLACE TEMPORARY VIEW ', 'gi')")
_rewrite("strip_terminator", sqltext.without_terminator,
         "regexp_replace(regexp_replace(sql, '^\\s+|\\s+$', '', 'g'), ';+$', '')")


@query("split_view_query", r"""
WITH v AS (SELECT id, list_filter(list_transform(string_split(sql, ';'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS parts
           FROM fx_sql_texts WHERE regexp_matches(sql, 'create\s+view', 'i'))
SELECT id, CAST(u.position AS INTEGER) AS position, parts[u.position] AS statement FROM v, unnest(generate_series(1, len(parts))) AS u(position)
""")
def split_view_query(fx: Fixtures) -> DataFrame:
    statements_of = sqltext.view_statements(F.col("sql"))
    return fx.sql_texts().select("id", F.posexplode(statements_of).alias("p", "statement")).select(
        "id", (F.col("p") + 1).alias("position"), "statement"
    )


@query("normalize_datasets_json", """
SELECT id, CASE WHEN id % 7 = 6 THEN datasets_json ELSE '["tpch/sf1"]' END AS datasets_json FROM fx_jobs
""")
def normalize_datasets_json(fx: Fixtures) -> DataFrame:
    return jobs.normalize_datasets(fx.jobs()).select("id", "datasets_json")


@query("legacy_columns", """
SELECT id, status, CAST(0 AS BIGINT) AS attempt_count, 'c5n.2xlarge' AS benchmark_instance_type,
       CAST(12 AS BIGINT) AS benchmark_node_count, CAST(NULL AS BIGINT) AS status_comment_id, '["tpch/sf1"]' AS datasets_json
FROM fx_jobs
""")
def legacy_columns(fx: Fixtures) -> DataFrame:
    old = fx.jobs().select("id", "comment_id", "requested_by", "dataset", "status", "created_at")
    required = ("id", "comment_id", "requested_by", "dataset", "status", "created_at")
    return jobs.legacy_columns(old, required).select(
        "id", "status", "attempt_count", "benchmark_instance_type", "benchmark_node_count", "status_comment_id",
        "datasets_json",
    )


@query("plan_output_rows", r"""
SELECT statement_id, page, TRY_CAST(nullif(regexp_extract(plan, '(?is)Output.*?([0-9]+)\s+rows', 1), '') AS BIGINT) AS rows
FROM fx_statement_pages WHERE plan IS NOT NULL
""")
def plan_output_rows(fx: Fixtures) -> DataFrame:
    return fx.statement_pages().where("plan IS NOT NULL").select(
        "statement_id", "page", statements.plan_output_rows(F.col("plan")).alias("rows")
    )


@query("queue_wait", """
SELECT id, greatest(0, CAST(date_diff('millisecond', created_at, created_at + (id % 900 - 300) * INTERVAL '1' SECOND) AS BIGINT)) AS queue_wait_ms
FROM fx_jobs
""")
def queue_wait(fx: Fixtures) -> DataFrame:
    later = F.col("created_at") + F.make_dt_interval(secs=F.col("id") % 900 - 300)
    return jobs.queue_wait(fx.jobs().withColumn("updated_at", later)).select("id", "queue_wait_ms")


@query("report_links", f"""
SELECT repository, number, '{SITE}/' || repository || '/commit/' || base_sha AS commit_url,
       '{SITE}/' || repository || '/compare/' || base_sha || '...' || head_sha AS compare_url,
       html_url || '#issuecomment-' || number AS request_url, substr(head_sha, 1, 12) AS short_sha
FROM fx_pull_requests
""")
def report_links(fx: Fixtures) -> DataFrame:
    repository, base, head = F.col("repository"), F.col("base_sha"), F.col("head_sha")
    return fx.pull_requests().select(
        "repository", "number", names.commit_url(SITE, repository, base).alias("commit_url"),
        names.compare_url(SITE, repository, base, head).alias("compare_url"),
        names.request_url(F.col("html_url"), F.col("number")).alias("request_url"),
        F.left(head, F.lit(12)).alias("short_sha"),
    )


@query("report_sink", f"WITH {LINES} SELECT dataset, line FROM texts")
def report_sink(fx: Fixtures) -> DataFrame:
    path = work_dir(fx.spark, "report")
    write_report(compare_pairs(fx.iteration_records(), pairs(fx)).lines(), path)
    return fx.spark.read.text(path).select("dataset", F.col("value").alias("line"))


# Reports of the jobs from the lines: the summary of a block and its details.
BLOCKS = f"""{LINES}, parts AS (
  SELECT dataset, string_agg(ltrim(line), chr(10) ORDER BY section) FILTER (section IN (0, 4, 5)) AS summary,
         coalesce(string_agg(line, chr(10) ORDER BY section, {NATURAL.format('id')}) FILTER (section IN (1, 2, 3)), '') AS details
  FROM texts GROUP BY 1),
wanted AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN [0, 2] ELSE [4, 1, 3] END AS ns FROM orders),
placed AS (SELECT job_id, CAST(u.place - 1 AS INTEGER) AS block,
                  'ev/' || ['click', 'error', 'purchase', 'signup', 'view'][(job_id + ns[u.place]) % 5 + 1] AS dataset
           FROM wanted, unnest(generate_series(1, len(ns))) AS u(place)),
blocks AS (SELECT job_id, block, p.dataset, summary, details FROM placed p JOIN parts ON parts.dataset = p.dataset)"""


@query("multi_dataset_report", f"""
WITH {BLOCKS},
whole AS (SELECT dataset, trim(string_agg(line, chr(10) ORDER BY section, {NATURAL.format('id')})) AS report FROM texts GROUP BY 1)
SELECT job_id, string_agg(report, chr(10) || chr(10) ORDER BY block) AS comparison, count(*) AS blocks
FROM blocks JOIN whole USING (dataset) GROUP BY 1
""")
def multi_dataset_report(fx: Fixtures) -> DataFrame:
    return job_comparisons(report_jobs(fx), compare_pairs(fx.iteration_records(), pairs(fx)))


# A text that ends in characters of two units each, cut to a size in units.
_ASTRAL, _ASTRALS, _LIMIT = "🟠", "(doc_id % 40)", "(200 + doc_id % 97)"
_TAIL = f"({_LIMIT} - {len(text.TRUNCATION_NOTICE)})"


@query("truncate_units", f"""
SELECT doc_id, CASE WHEN length(t) + 2 * k <= {_LIMIT} THEN t || repeat('{_ASTRAL}', CAST(k AS INTEGER))
  ELSE '{text.TRUNCATION_NOTICE.strip()}' || chr(10) || CASE WHEN {_TAIL} >= 2 * k
         THEN right(t, CAST({_TAIL} - 2 * k AS INTEGER)) || repeat('{_ASTRAL}', CAST(k AS INTEGER))
         ELSE CASE WHEN {_TAIL} % 2 = 1 THEN chr(65533) ELSE '' END || repeat('{_ASTRAL}', CAST({_TAIL} // 2 AS INTEGER)) END END AS shown
FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '?', 'g') AS t, {_ASTRALS} * 4 AS k FROM documents) d
""")
def truncate_units(fx: Fixtures) -> DataFrame:
    ends = F.repeat(F.lit(_ASTRAL), F.expr(f"CAST({_ASTRALS} * 4 AS INT)"))
    value = F.concat(F.regexp_replace("text", "[^ -~]", "?"), ends)
    cut = text.truncate_tail(F.col("value"), F.expr(f"CAST({_LIMIT} AS INT)"))
    return fx.table("documents").withColumn("value", value).select("doc_id", cut.alias("shown"))


@query("split_report_blocks", f"WITH {BLOCKS} SELECT job_id, block, true AS structured, summary, details FROM blocks")
def split_report_blocks(fx: Fixtures) -> DataFrame:
    texts = job_comparisons(report_jobs(fx), compare_pairs(fx.iteration_records(), pairs(fx)))
    return report.split_report_blocks(texts, ["job_id"], "comparison").select(
        "job_id", "block", "structured", "summary", "details"
    )


@query("render_messages", f"""
SELECT comment_id, 'Requested by [this comment](https://example.org/p/' || comment_id || '#issuecomment-' || comment_id || ').'
       || chr(10) || chr(10) || 'Benchmark job ' || comment_id || ' queued for `' || replace(datasets, ',', '`, `') || '` on ' || nodes || ' `' || instance_type || '` nodes.' AS queued,
       'Requested by [this comment](https://example.org/p/' || comment_id || '#issuecomment-' || comment_id || ').'
       || chr(10) || chr(10) || 'Running `' || replace(datasets, ',', '`, `') || '` on ' || nodes || ' `' || instance_type || '` nodes.' AS running
FROM ({EXPECTED_COMMANDS}) c WHERE kind = 'request'
""")
def render_messages(fx: Fixtures) -> DataFrame:
    requests = parse_commands(fx.comments()).where("kind = 'request'").select(
        "*", F.col("comment_id").alias("id"),
        F.concat(F.lit("https://example.org/p/"), F.col("comment_id").cast("string")).alias("pull_request_url"),
    )
    return requests.select(
        "comment_id", report.queued_message().alias("queued"), report.running_message().alias("running")
    )


def finished_jobs(fx: Fixtures) -> DataFrame:
    key = F.col("id").cast("string")
    sha = lambda side: F.left(F.concat(F.md5(F.concat(F.lit(side), key)), F.md5(key)), F.lit(40))
    return report_jobs(fx).select(
        "id", "datasets", F.col("id").alias("comment_id"), F.lit("o/r").alias("repository"),
        F.concat(F.lit("https://example.org/o/r/pull/"), key).alias("pull_request_url"),
        sha("b").alias("base_sha"), sha("h").alias("head_sha"),
        F.lit(12).alias("nodes"), F.lit("c5n.2xlarge").alias("instance_type"),
        (F.col("id") * 10).alias("base_deploy_ms"), (F.col("id") * 11).alias("head_deploy_ms"),
        (F.col("id") * 3).alias("queue_wait_ms"), F.lit(2000).alias("validation_ms"),
        (F.col("id") * 100).alias("total_ms"),
    )


_DURATION = """CASE WHEN {0} < 60 THEN {0} || 's' WHEN {0} < 3600 THEN ({0} // 60) || 'm ' || ({0} % 60) || 's'
  ELSE ({0} // 3600) || 'h ' || ({0} // 60 % 60) || 'm ' || ({0} % 60) || 's' END"""
_SECONDS = "CAST(floor(({0}) / 1000.0 + 0.5) AS BIGINT)"
_NL = "chr(10)"


def _shown(milliseconds: str) -> str:
    return _DURATION.format("(" + _SECONDS.format(milliseconds) + ")")


def _commit(column: str) -> str:
    return f"'{SITE}/o/r/commit/' || {column}"


# Timings cover the orders that have lines; the comparison is short enough to be shown whole.
_RENDERED = f"""{BLOCKS},
shown AS (SELECT job_id, string_agg('<pre>' || summary || '</pre>' || {_NL} || {_NL} || '<details>' || {_NL}
    || '<summary>Show full query output</summary>' || {_NL} || {_NL} || '<pre>' || details || '</pre>' || {_NL} || {_NL} || '</details>',
    {_NL} || {_NL} ORDER BY block) AS comparison, string_agg('`' || dataset || '`', ', ' ORDER BY block) AS names FROM blocks GROUP BY 1),
paired AS (SELECT job_id, pos, coalesce(max(dataset) FILTER (side = 'base'), max(dataset)) AS dataset,
    coalesce(max(duration_ms) FILTER (side = 'base'), 0.0) AS base_ms, coalesce(max(duration_ms) FILTER (side = 'head'), 0.0) AS head_ms
    FROM fx_timings GROUP BY 1, 2),
phases AS (SELECT job_id, string_agg('| Benchmark `' || dataset || '` | ' || {_shown('base_ms')} || ' | ' || {_shown('head_ms')} || ' |', {_NL} ORDER BY pos) AS rows
    FROM paired GROUP BY 1),
sums AS (SELECT job_id, CAST(coalesce(sum(CAST(duration_ms AS DECIMAL(18,3))) FILTER (side = 'base'), 0) AS DOUBLE) AS base_ms,
    CAST(coalesce(sum(CAST(duration_ms AS DECIMAL(18,3))) FILTER (side = 'head'), 0) AS DOUBLE) AS head_ms FROM fx_timings GROUP BY 1),
keyed AS (SELECT s.*, substr(md5('b' || s.job_id) || md5(CAST(s.job_id AS VARCHAR)), 1, 40) AS base_sha,
    substr(md5('h' || s.job_id) || md5(CAST(s.job_id AS VARCHAR)), 1, 40) AS head_sha,
    coalesce(p.rows, '') AS rows, coalesce(t.base_ms, 0.0) AS base_ms, coalesce(t.head_ms, 0.0) AS head_ms
    FROM shown s LEFT JOIN phases p ON p.job_id = s.job_id LEFT JOIN sums t ON t.job_id = s.job_id)
SELECT job_id AS id, 'Requested by [this comment](https://example.org/o/r/pull/' || job_id || '#issuecomment-' || job_id || ').'
  || {_NL} || {_NL} || '## Benchmark results' || {_NL} || {_NL} || '**Compared:** [Base `' || substr(base_sha, 1, 12) || '`](' || {_commit('base_sha')}
  || ') → [PR head `' || substr(head_sha, 1, 12) || '`](' || {_commit('head_sha')} || ') · [View exact source diff]({SITE}/o/r/compare/' || base_sha || '...' || head_sha || ')'
  || {_NL} || {_NL} || comparison || {_NL} || {_NL} || '<details>' || {_NL} || '<summary>Verification and run details</summary>' || {_NL} || {_NL} || 'Job `' || job_id
  || '` captured both immutable revisions when the request was queued. The bot fetched and checked out each full commit SHA in detached HEAD, then built and deployed the `worker` target from that checkout.'
  || {_NL} || {_NL} || '| Identity | Base | PR head |' || {_NL} || '| --- | --- | --- |' || {_NL} || '| Source commit | [`' || base_sha || '`](' || {_commit('base_sha')} || ') | [`' || head_sha || '`](' || {_commit('head_sha')} || ') |'
  || {_NL} || {_NL} || '| Phase | Base | PR head |' || {_NL} || '| --- | ---: | ---: |' || {_NL} || '| Build and deployment | ' || {_shown('job_id * 10')} || ' | ' || {_shown('job_id * 11')} || ' |'
  || {_NL} || '| All benchmarks | ' || {_shown('base_ms')} || ' | ' || {_shown('head_ms')} || ' |' || {_NL} || rows || {_NL} || {_NL} || '**Workload:** ' || names
  || ' · all queries · 1 warmup + 5 measured iterations per query' || {_NL} || {_NL} || '**Capacity:** 12 `c5n.2xlarge` nodes for both revisions' || {_NL} || {_NL}
  || '**Other timings:** Queue ' || {_shown('job_id * 3')} || ' · Dataset validation 2s · Total ' || {_shown('job_id * 100')} || {_NL} || {_NL} || '</details>' AS message
FROM keyed"""


@query("render_report", f"WITH {_RENDERED}")
def render_report(fx: Fixtures) -> DataFrame:
    comparison = compare_pairs(fx.iteration_records(), pairs(fx))
    return result_reports(finished_jobs(fx), comparison, fx.timings(), SITE)
