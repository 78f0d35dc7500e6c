"""Text functions, SQL rewrites and job reports."""

import re
from datetime import datetime, timezone
from types import SimpleNamespace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lapwise.contract import QUERIES
from lapwise.functions import sqltext, text
from lapwise.operators import report
from lapwise.plans.job_report import job_comparisons, list_blocks, result_reports

# Texts that must match.
BLOCK = """=== Comparing tpch/sf1 results 'base' [prev] with 'head' [new] ===
      q1: prev= 100 ms, new= 120 ms, diff=1.20 slower ✖
      q2: prev= 200 ms, new= 150 ms, diff=1.33 faster ✔
   TASKS: prev=20.0, new=18.0, diff=2.0 fewer (10.0%) (sum of per-query averages)
   TOTAL: prev=300 ms, new=270 ms, diff=1.11 faster ✅"""


def apply(spark, function, value):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v")).alias("r")).head()["r"]


@pytest.mark.parametrize(
    "ms, shown",
    [(122000, "2m 2s"), (125000, "2m 5s"), (30000, "30s"), (31000, "31s"), (420000, "7m 0s"), (-5, "0s"), (499, "0s"),
     (500, "1s"), (59500, "1m 0s"), (3603000, "1h 0m 3s"), (3599499, "59m 59s")],
)
def test_durations(spark, ms, shown):
    assert spark.range(1).select(text.format_duration(F.lit(ms)).alias("r")).head()["r"] == shown


def test_padding_escaping_and_tails(spark):
    assert apply(spark, lambda v: text.pad_start(v, 8), "q1") == "      q1"
    assert apply(spark, lambda v: text.pad_start(v, 8), "abcdefghij") == "abcdefghij"
    assert apply(spark, text.html_escape, "&lt;<a>&") == "&amp;lt;&lt;a&gt;&amp;"
    assert apply(spark, lambda v: text.truncate_tail(v, F.lit(40)), "x" * 40) == "x" * 40
    assert apply(spark, lambda v: text.truncate_tail(v, F.lit(31)), "y" * 40) == text.TRUNCATION_NOTICE + "yy"
    assert apply(spark, lambda v: text.truncate_tail(v, F.lit(5)), "y" * 40) == "... e"
    assert apply(spark, lambda v: text.truncate_tail(v, F.lit(0)), "y") == ""


def test_byte_tail_keeps_characters_whole(spark):
    for value in ("x" * 10000 + "-tail", "é" * 100, "日本語" * 50, "a🟠" * 40, "short", ""):
        for size in (1, 2, 3, 4, 5, 32):
            got = apply(spark, lambda v: text.utf8_tail(v, size), value)
            data = value.encode()
            start = max(0, len(data) - size)
            while 0 < start < len(data) and data[start] & 0xC0 == 0x80:
                start += 1
            assert got == data[start:].decode()


def test_sql_rewrites(spark):
    date = lambda s: apply(spark, sqltext.date_literals, s)
    assert date("x >= '1997-01-01'") == "x >= DATE '1997-01-01'"
    assert date("x >= date '1997-01-01' + 1") == "x >= DATE '1997-01-01' + 1"
    assert date("x >= date   '1997-01-01'") == "x >= DATE '1997-01-01'"
    assert date("in('1997-01-01','1998-01-01')") == "in(DATE '1997-01-01',DATE '1998-01-01')"
    assert date("'1997-1-01'") == "'1997-1-01'"
    assert apply(spark, sqltext.epoch_function, "TO_timestamp_SECONDS(x)") == "timestamp_seconds(x)"
    assert apply(spark, sqltext.temporary_view, "create  or replace view a") == "CREATE OR REPLACE TEMPORARY VIEW a"
    assert apply(spark, sqltext.without_terminator, " select 1 ;; ") == "select 1 "
    three = "create view v as select 1; select * from v;; drop view v;\n"
    assert apply(spark, sqltext.view_statements, three) == ["create view v as select 1", "select * from v", "drop view v"]
    assert apply(spark, sqltext.view_statements, "select 1; select 2") is None
    with pytest.raises(PySparkException, match="three statements"):
        apply(spark, sqltext.view_statements, "create view v as select 1")


def result(spark, comparison, **changes):
    job = {
        "id": 3, "comment_id": 7, "repository": "o/r", "pull_request_url": "https://example.org/o/r/pull/99",
        "datasets": ["tpch/sf1", "tpch/sf100"], "nodes": 12, "instance_type": "c7i.2xlarge", "base_sha": "a" * 40,
        "head_sha": "b" * 40, "comparison": comparison, "base_deploy_ms": 122000, "head_deploy_ms": 125000,
        "base_ms": 60000, "head_ms": 63000, "queue_wait_ms": 0, "validation_ms": 2000, "total_ms": 420000,
        "phases": [(0, "tpch/sf1", 10000.0, 11000.0), (1, "tpch/sf100", 30000.0, 31000.0)], **changes,
    }
    schema = (
        "id bigint, comment_id bigint, repository string, pull_request_url string, datasets array<string>, nodes int, "
        "instance_type string, base_sha string, head_sha string, comparison string, base_deploy_ms bigint, "
        "head_deploy_ms bigint, base_ms bigint, head_ms bigint, queue_wait_ms bigint, validation_ms bigint, "
        "total_ms bigint, phases array<struct<pos:bigint,dataset:string,base_ms:double,head_ms:double>>"
    )
    df = spark.createDataFrame([job], schema)
    blocks = df.withColumn("blocks", report.sized_blocks(F.col("comparison")))
    return blocks.select(report.result_message("https://example.org", "worker").alias("m")).head()["m"]


def test_result_report(spark):
    message = result(spark, BLOCK)
    for part in (
        "TOTAL: prev=300 ms, new=270 ms", "TASKS: prev=20.0, new=18.0", "Show full query output", "q1: prev= 100 ms",
        "pull/99#issuecomment-7", "## Benchmark results", f"/compare/{'a' * 40}...{'b' * 40}", "Base `aaaaaaaaaaaa`",
        "PR head `bbbbbbbbbbbb`", "detached HEAD", "1 warmup + 5 measured iterations per query",
        "Build and deployment | 2m 2s | 2m 5s", "Benchmark `tpch/sf100` | 30s | 31s", "Total 7m 0s",
        "12 `c7i.2xlarge` nodes", "`tpch/sf1`, `tpch/sf100`",
    ):
        assert part in message, part
    assert message.count("=== Comparing") == 1 and message.count("TOTAL:") == 1
    summary, details = message.split("</pre>\n\n<details>\n<summary>Show", 1)
    assert "TASKS:" in summary and "TOTAL:" in summary and "q1:" not in summary and "q1:" in details


def test_reports_stay_within_their_limit(spark):
    block = lambda n: f"=== Comparing d{n} results\n" + "&<>" * 30_000 + f"\n   TASKS: x\n   TOTAL: end {n}"
    message = result(spark, "\n\n".join(block(n) for n in range(3)))
    assert len(message) <= report.MESSAGE_LIMIT
    assert "&amp;&lt;&gt;" in message and message.count(text.TRUNCATION_NOTICE) == 3
    assert all(f"TOTAL: end {n}" in message for n in range(3))
    assert len(result(spark, "plain & " * 50_000)) <= report.MESSAGE_LIMIT
    assert "<pre>" not in result(spark, " \n ")


def units(value):
    return len(value.encode("utf-16-be")) // 2


def truncated(value, limit):
    """Truncation by UTF-16 units, as strings of such units do it."""
    if units(value) <= limit:
        return value
    if limit <= len(text.TRUNCATION_NOTICE):
        return text.TRUNCATION_NOTICE[: max(0, limit)]
    tail = value.encode("utf-16-be")[-2 * (limit - len(text.TRUNCATION_NOTICE)) :]
    half = 0xDC <= tail[0] <= 0xDF
    return text.TRUNCATION_NOTICE + ("\ufffd" if half else "") + tail[2 * half :].decode("utf-16-be")


def test_sizes_are_counted_in_units(spark):
    for value in ("plain" * 20, "🟠" * 50, "a🟠" * 40, "é" * 90, "🟠" + "b" * 60, ""):
        for limit in (0, 3, 29, 30, 31, 32, 60, 99, 100, 101):
            assert apply(spark, lambda v: text.truncate_tail(v, F.lit(limit)), value) == truncated(value, limit), (value, limit)


@pytest.mark.parametrize("filler", ["x", "🟠"])
def test_a_message_fills_its_limit_exactly(spark, filler):
    frame = units(result(spark, "")) + len("<pre></pre>")
    room = report.MESSAGE_LIMIT - frame
    whole = filler * (room // units(filler)) + "y" * (room % units(filler))
    message = result(spark, whole)
    assert units(message) == report.MESSAGE_LIMIT and text.TRUNCATION_NOTICE not in message and whole in message
    longer = result(spark, whole + "z")
    assert units(longer) == report.MESSAGE_LIMIT
    assert longer.split("<pre>")[1].split("</pre>")[0] == truncated(whole + "z", room)


def test_all_phases_are_shown(spark):
    phases = [(i, f"d{i}", 1000.0, 2000.0) for i in range(300)]
    assert result(spark, BLOCK, phases=phases).count("| Benchmark `d") == 300


def test_blocks(spark):
    parts = spark.createDataFrame([(1, f"{BLOCK}\n\n{BLOCK}\n\n=== Comparing only a header")], "k int, report string")
    found = report.split_report_blocks(parts, ["k"]).orderBy("block").collect()
    assert [r["structured"] for r in found] == [True, True, False]
    assert found[0]["summary"].split("\n")[1].startswith("TASKS:") and found[0]["details"].count("\n") == 1


def test_messages(spark):
    job = spark.createDataFrame(
        [(5, 9, "u", ["a/b"], 6, "c5n.2xlarge", 3, 10, "Deploying the base revision")],
        "id int, comment_id int, pull_request_url string, datasets array<string>, nodes int, instance_type string, "
        "step int, total int, message string",
    )
    show = lambda column: job.select(column.alias("m")).head()["m"]
    link = "Requested by [this comment](u#issuecomment-9).\n\n"
    assert show(report.queued_message()) == f"{link}Benchmark job 5 queued for `a/b` on 6 `c5n.2xlarge` nodes."
    assert show(report.progress_message()).endswith("\n\n**Progress 3/10:** Deploying the base revision.")
    assert "controller journal" in show(report.failure_message())


def test_texts_hold_all_lines_in_order(spark):
    data = [("d", 0, None, "head"), ("d", 5, None, "total"), ("d", 1, "z", "line z")]
    data += [("d", 1, f"q{i}", f"line {i}") for i in range(3000)]
    lines = spark.createDataFrame(data, "dataset string, section int, id string, line string").repartition(7)
    expected = ["head", *[f"line {i}" for i in range(3000)], "line z", "total"]
    assert report.report_texts(lines).head()["report"].split("\n") == expected


def _report_lines(spark, n):
    """Lines of a dataset with n queries, in ranges and order of their own, beside a small one."""
    numbers = spark.range(n).select(
        F.lit("big").alias("dataset"), F.lit(1).alias("section"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("id"),
        F.concat(F.lit("   q"), F.col("id").cast("string"), F.lit(": <a> 🟠")).alias("line"),
    )
    frame = [("big", 0, None, "=== Comparing big"), ("big", 4, None, "  TASKS: 1"), ("big", 5, None, "  TOTAL: 2"),
             ("small", 0, None, "=== Comparing small"), ("small", 1, "z", "   z: & 🟠"), ("small", 1, "q2", "   q2: x"),
             ("small", 2, None, "QERR"), ("small", 4, None, "  TASKS: 3"), ("small", 5, None, "  TOTAL: 4")]
    return numbers.unionByName(spark.createDataFrame(frame, "dataset string, section int, id string, line string")).repartition(5)


def test_reports_from_lines_are_those_from_texts(spark):
    lines = _report_lines(spark, 9_000)
    texts = report.trimmed_texts(report.report_texts(lines)).select("dataset", report.sized_blocks(F.col("report")).alias("blocks"))
    plain = lambda df: {r["dataset"]: [b.asDict(True) for b in r["blocks"]] for r in df.collect()}
    found = plain(report.sized_reports(lines))
    assert found == plain(texts)
    assert found["big"][0]["details"]["units"] > 2 * report.MESSAGE_LIMIT == 2 * units(found["big"][0]["details"]["tail"])
    assert found["big"][0]["summary"]["tail"] == "=== Comparing big\nTASKS: 1\nTOTAL: 2"


def test_only_lines_within_the_limit_are_gathered(spark):
    lines = _report_lines(spark, 400_000)
    tail = report.line_tails(lines.where("dataset = 'big'"), ["dataset"], 40).head()
    assert tail["tail"].endswith("q399999: <a> 🟠\n  TASKS: 1\n  TOTAL: 2") and units(tail["tail"]) == 40
    assert tail["units"] == sum(units(r["line"]) + 1 for r in lines.where("dataset = 'big'").select("line").toLocalIterator()) - 1


def test_blocks_after_any_end_of_a_line(spark):
    head = report.BLOCK_START
    ends = ["\n", "\r\n", "\r", "\u0085", "\u2028", "\n \x0b\n"]
    texts = [f" \t{head}a\nx {head}y{end}{head}b\n TOTAL: 1\r\n{head}\n" for end in ends] + ["", " \n\f", "x\ty", f"\n\n{head}", "\u00a0 z\u2003"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    ws = " \t\n\x0b\f\r"
    found = {r["k"]: r["b"] for r in rows.select("k", report.report_blocks(F.col("t")).alias("b")).collect()}
    for k, text in enumerate(texts):
        parts = re.split(f"(?:^|(?<=[\n\r\u0085\u2028\u2029]))(?={head})", text.strip(ws))
        assert found[k] == [p.strip(ws) for p in parts if p.strip(ws)]


def test_texts_pass_no_shuffle_by_job(spark):
    jobs = spark.range(40).select("id", F.expr("IF(id % 2 = 0, array('a', 'b'), array('b', 'c', 'b'))").alias("datasets"))
    jobs = jobs.unionByName(spark.createDataFrame([(100, None), (101, []), (102, ["none"])], "id long, datasets array<string>"))
    lines = spark.createDataFrame([(d, n, None, f"{head}{d}") for d in "abc" for n, head in ((0, report.BLOCK_START), (5, "TOTAL: "))], "dataset string, section int, id string, line string")
    comparison = SimpleNamespace(lines=lambda: lines)
    found = job_comparisons(jobs, comparison)
    expected = lambda names: "\n\n".join(f"{report.BLOCK_START}{n}\nTOTAL: {n}" for n in names)
    assert {r["job_id"]: r["comparison"] for r in found.collect()} == {i: expected("bcb" if i % 2 else "ab") for i in range(40)}
    # texts are read from what was written once, and nothing above that read shuffles them
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    blocks = {tuple(r["datasets"]): r["blocks"] for r in list_blocks(jobs, comparison).collect()}
    assert {k: [b["summary"]["tail"] for b in v] for k, v in blocks.items()} == {tuple(k): [expected(n) for n in k] for k in ("ab", "bcb")}


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_phases_and_totals_of_a_job_pass_one_shuffle(spark):
    lines = spark.createDataFrame([("a", n, None, f"{head}a") for n, head in ((0, report.BLOCK_START), (5, "TOTAL: "))], "dataset string, section int, id string, line string")
    jobs = spark.range(4).select(
        "id", F.array(F.lit("a")).alias("datasets"), F.col("id").alias("comment_id"), F.lit("o/r").alias("repository"),
        F.lit("u").alias("pull_request_url"), F.lit("b" * 40).alias("base_sha"), F.lit("h" * 40).alias("head_sha"), F.lit(2).alias("nodes"),
        F.lit("t").alias("instance_type"), *[F.lit(0).alias(f"{n}_ms") for n in ("base_deploy", "head_deploy", "queue_wait", "validation", "total")],
    )
    timings = [(0, "head", 0, "x", 4000.0), (0, "base", 1, "y", 2000.0), (0, "base", 0, "z", 61000.0), (1, "head", 0, "x", 1500.0), (2, "other", 0, "x", 5.0), (9, "base", 0, "x", 1.0)]
    dealt = spark.createDataFrame(timings, "job_id bigint, side string, pos bigint, dataset string, duration_ms double").repartition("job_id")
    found = result_reports(jobs, SimpleNamespace(lines=lambda: lines), dealt, "https://example.org")
    # one of the timings, made by the caller, and one of the jobs
    assert _shuffles(found) == 2
    shown = {r["id"]: re.findall(r"\| All benchmarks \|.*\n((?:\| Benchmark .*\n)*)", r["message"])[0].splitlines() for r in found.collect()}
    assert shown == {0: ["| Benchmark `z` | 1m 1s | 4s |", "| Benchmark `y` | 2s | 0s |"], 1: ["| Benchmark `x` | 0s | 2s |"], 2: ["| Benchmark `x` | 0s | 0s |"], 3: []}
    totals = {r["id"]: re.findall(r"\| All benchmarks \| (.*) \|\n", r["message"])[0] for r in found.collect()}
    assert totals == {0: "1m 3s | 4s", 1: "0s | 2s", 2: "0s | 0s", 3: "0s | 0s"}


def test_timings_are_read_and_shuffled_once_for_messages(spark, sf_dir):
    messages = QUERIES["render_report"](spark, sf_dir)
    plan = messages._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_orderkey") == 1 and _shuffles(messages) <= 2
