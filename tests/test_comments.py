"""Commands, outcomes, admission, watermarks and retries."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from conftest import rows
from lapwise.functions.commands import USAGE, parse_commands
from lapwise.operators.admission import admit_requests
from lapwise.operators.comments import retry_schedule, settled_watermark
from lapwise.operators.jobs import (
    claim_next, legacy_columns, next_pending, normalize_datasets, progress_steps, queue_wait, recover_running,
)
from lapwise.operators.statements import fold_statements
from lapwise.plans.comments import process_comments

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
DEFAULT = ("c5n.2xlarge", 12)
# Texts that must match.
REQUESTS = {
    "benchmarks run tpch/sf1": (["tpch/sf1"], *DEFAULT),
    "benchmarks run tpch/sf1 tpch/sf10 tpch/sf100 --nodes 6": (["tpch/sf1", "tpch/sf10", "tpch/sf100"], "c5n.2xlarge", 6),
    "benchmarks run tpch/sf1 --instance-type c7i.2xlarge --nodes 12": (["tpch/sf1"], "c7i.2xlarge", 12),
    "benchmarks run tpch/sf1 --nodes 12 --instance-type c7i.2xlarge": (["tpch/sf1"], "c7i.2xlarge", 12),
    "benchmarks run tpch/sf1 --nodes 4": (["tpch/sf1"], "c5n.2xlarge", 4),
    "benchmarks run tpch/sf1 --instance-type c7i.2xlarge": (["tpch/sf1"], "c7i.2xlarge", 12),
    "\n \r\n  benchmarks run\ttpch/sf1　\nsecond line --nodes 99": (["tpch/sf1"], *DEFAULT),
    "benchmarks run ../..": (["../.."], *DEFAULT),
    "benchmarks run tpch/sf1 --nodes 24": (["tpch/sf1"], "c5n.2xlarge", 24),
}
# Texts that must match.
INVALID = {
    "benchmarks run tpch/sf1 --instance-type c7i.2xlarge --nodes 25": "Invalid node count `25`; expected an integer from 1 to 24.",
    "benchmarks run tpch/sf1 --instance-type $(whoami) --nodes 12": "Invalid instance type `$(whoami)`.",
    "benchmarks run tpch/sf1 --instance-type c7i.2xlarge --nodes 1.5": "Invalid node count `1.5`; expected an integer from 1 to 24.",
    "benchmarks run tpch/sf1 --nodes 01": "Invalid node count `01`; expected an integer from 1 to 24.",
    "benchmarks run tpch/sf1 --nodes 99999999999999999999": "Invalid node count `99999999999999999999`; expected an integer from 1 to 24.",
    "benchmarks run tpch_sf1 --instance-type c7i.2xlarge --nodes 12": "Invalid dataset `tpch_sf1`; expected a path such as `tpch/sf1`.",
    "benchmarks run tpch/sf1 --instance-type c7i.2xlarge --nodes 12 now": USAGE,
    "benchmarks run": USAGE,
    "benchmarks run --nodes 3": USAGE,
    "benchmarks run tpch/sf1 --nodes": USAGE,
    "benchmarks run tpch/sf1 --speed 3": USAGE,
    "benchmarks run tpch/sf1 --nodes 3 --nodes 3": USAGE,
    "benchmarks run tpch/sf1 tpch/sf1": "Each dataset may be requested only once.",
    # the dataset is checked before the options
    "benchmarks run bad --speed 3": "Invalid dataset `bad`; expected a path such as `tpch/sf1`.",
}
NONE = ["looks good", "", "  \n ", "please\nbenchmarks run tpch/sf1", "benchmarks", "Benchmarks run tpch/sf1", "benchmarks runs a/b"]


def test_commands(spark):
    bodies = [*REQUESTS, *INVALID, *NONE]
    df = parse_commands(spark.createDataFrame(list(enumerate(bodies)), "n int, body string"))
    found = {r["n"]: r for r in df.collect()}
    for n, body in enumerate(bodies):
        r = found[n]
        if body in REQUESTS:
            assert (r["kind"], r["datasets"], r["instance_type"], r["nodes"]) == ("request", *REQUESTS[body]), body
        elif body in INVALID:
            assert (r["kind"], r["message"], r["datasets"]) == ("invalid", INVALID[body], None), body
        else:
            assert (r["kind"], r["message"]) == ("none", None), body


def test_admission_equals_deciding_one_by_one(spark):
    rng = random.Random(11)
    requests, active, expected = [], [], {}
    for queue in range(120):
        used = {f"u{i}": rng.randint(0, 5) for i in range(rng.randint(0, 6))}
        active += [(queue, u, n) for u, n in used.items() if n]
        total, own = sum(used.values()), dict(used)
        for i in range(rng.randint(0, 60)):
            user, id = f"u{rng.randint(0, 9)}", queue * 1000 + i
            requests.append((queue, user, id, T0 + timedelta(seconds=i // 3)))
            if total >= 20:
                expected[id] = "queue_full"
            elif own.get(user, 0) >= 3:
                expected[id] = "requester_limit"
            else:
                expected[id] = "admitted"
                total, own[user] = total + 1, own.get(user, 0) + 1
    rng.shuffle(requests)
    decided = admit_requests(
        spark.createDataFrame(requests, "queue bigint, requested_by string, comment_id bigint, arrived_at timestamp"),
        spark.createDataFrame(active, "queue bigint, requested_by string, active bigint"),
    )
    assert dict(rows(decided, "comment_id", "decision")) == expected


def test_requester_names_differ_by_case(spark):
    requests = [(0, u, i, T0) for i, u in enumerate(["Ann", "Ann", "Ann", "ann", "Ann"])]
    decided = admit_requests(
        spark.createDataFrame(requests, "queue bigint, requested_by string, comment_id bigint, arrived_at timestamp"),
        spark.createDataFrame([], "queue bigint, requested_by string, active bigint"),
    )
    assert [d for _, d in rows(decided, "comment_id", "decision")] == ["admitted"] * 4 + ["requester_limit"]


def test_watermark_equals_the_sequential_rule(spark):
    rng = random.Random(4)
    feed, current, expected = [], [], {}
    poll, overlap = T0 + timedelta(hours=5), timedelta(minutes=2)
    for n in range(150):
        repository = f"r{n}"
        position = T0 + timedelta(minutes=rng.randint(-60, 200))
        current.append((repository, position))
        comments = sorted(
            (T0 + timedelta(minutes=rng.randint(0, 120)), id, rng.random() < 0.8) for id in range(rng.randint(1, 12))
        )
        feed += [(repository, id, at, settled) for at, id, settled in comments]
        open_ = True
        for at, _, settled in comments:
            open_ = open_ and settled
            if open_:
                position = max(position, at - overlap)
        expected[repository] = max(position, poll - overlap) if open_ else position
    rng.shuffle(feed)
    state = settled_watermark(
        spark.createDataFrame(feed, "repository string, comment_id bigint, updated_at timestamp, settled boolean"),
        spark.createDataFrame(current, "repository string, scanned_through timestamp"),
        F.lit(poll).cast("timestamp"),
    )
    micros = state.select("repository", F.unix_seconds("scanned_through").alias("s"))
    assert dict(rows(micros)) == {k: int(v.timestamp()) for k, v in expected.items()}


def test_statement_fold_equals_reading_pages(spark):
    rng = random.Random(9)
    pages, expected = [], {}
    for statement in range(200):
        plan, count, elapsed = "", 0, 0
        for page in range(rng.randint(1, 9)):
            text = rows_ = took = None
            kind = rng.choice(["plan", "match", "data", "empty"])
            if kind == "plan":
                text = plan = f"Fragment {page}"
            elif kind == "match":
                count = rng.randint(0, 99)
                text = plan = f"x\nOUTPUT [a]\n more {count} rows and 7 rows"
            elif kind == "data":
                rows_ = rng.randint(0, 9)
                count += rows_
            if rng.random() < 0.6:
                took = elapsed = rng.randint(1, 999)
            pages.append((statement, page, text, rows_, took))
        expected[statement] = (plan, count, elapsed)
    rng.shuffle(pages)
    folded = fold_statements(
        spark.createDataFrame(pages, "statement_id bigint, page bigint, plan string, data_rows bigint, elapsed_ms bigint")
    )
    found = {s: (p, n, e) for s, p, n, e in rows(folded, "statement_id", "plan", "row_count", "elapsed_ms")}
    assert found == expected


def test_retry_delays(spark):
    failures = [(1, n, T0 + timedelta(hours=n), "e" * 5000) for n in range(5)] + [(2, 9, T0, "once")]
    schedule = retry_schedule(
        spark.createDataFrame(failures, "comment_id bigint, failure_id bigint, failed_at timestamp, error string")
    )
    assert rows(schedule, "comment_id", "attempt", "delay_seconds", "dropped", F.length("last_error")) == [
        (1, 1, 30, False, 4000), (1, 2, 60, False, 4000), (1, 3, 120, True, 4000), (2, 1, 30, False, 4)
    ]


JOBS = "id bigint, comment_id bigint, status string, status_comment_id bigint, attempt_count bigint, error string"


def test_claims_and_recovery(spark):
    jobs = spark.createDataFrame(
        [(1, 1, "pending", None, 0, None), (2, 2, "pending", 5, 0, None), (3, 3, "pending", 6, 0, None)], JOBS
    )
    assert [r["id"] for r in next_pending(jobs).collect()] == [2]
    for attempt, status in ((1, "pending"), (2, "pending"), (3, "failed")):
        jobs = claim_next(jobs)
        assert rows(jobs.where("id = 2"), "status", "attempt_count") == [("running", attempt)]
        jobs = recover_running(jobs).select(*jobs.columns)
        assert rows(jobs.where("id = 2"), "status") == [(status,)]
    assert rows(jobs.where("id = 2"), "error") == [("Controller restarted during this job 3 times",)]
    assert [r["id"] for r in next_pending(jobs).collect()] == [3]


def test_dataset_lists(spark):
    shapes = [None, "not-json", "[]", '{"a":1}', '["a",1]', '["a",null]', '["a","b"]', '"a"', '[["a"]]', '["",  "x"]', "[null]"]
    df = spark.createDataFrame([(i, "d/v", s) for i, s in enumerate(shapes)], "id int, dataset string, datasets_json string")
    kept = {r["id"]: r["datasets_json"] for r in normalize_datasets(df).collect()}
    assert [i for i, s in enumerate(shapes) if kept[i] == s] == [6, 9]
    assert all(kept[i] == '["d/v"]' for i in range(len(shapes)) if i not in (6, 9))


def test_legacy_jobs(spark):
    with pytest.raises(ValueError, match="it has no comment_id"):
        legacy_columns(spark.createDataFrame([(1, "d")], "id int, dataset string"), ("id", "comment_id"))


def test_progress_steps_and_waiting(spark):
    job = spark.createDataFrame([(1, ["a/b", "c/d"])], "id bigint, datasets array<string>")
    steps = rows(progress_steps(job), "step", "total", "message")
    assert len(steps) == 10 and {s[1] for s in steps} == {10}
    assert dict((s[0], s[2]) for s in steps)[5] == "Benchmarking base: c/d"
    times = spark.createDataFrame([(T0, T0 - timedelta(seconds=1)), (T0, T0 + timedelta(seconds=2))], "created_at timestamp, updated_at timestamp")
    assert rows(queue_wait(times), "queue_wait_ms") == [(0,), (2000,)]


def test_poll_outcomes(spark):
    issue, pull = "https://x/issues/7", "https://x/pulls/7"
    data = [
        (1, "r", 0, "Ann", issue, "benchmarks run a/b"), (2, "r", 0, "ann", issue, "hello"),
        (3, "r", 0, "ann", pull, "benchmarks run a/b"), (4, "r", 0, "eve", issue, "benchmarks run a/b"),
        (5, "r", 0, "ann", issue, "benchmarks run"), (6, "r", 0, "ann", "https://x/issues/8", "benchmarks run a/b"),
        (7, "r", 0, "ann", "https://x/issues/8", "benchmarks run a/b"), (8, "r", 0, "ann", "https://x/issues/8", "benchmarks run a/b"),
        (9, "r", 0, "ann", issue, "benchmarks run a/b"), (10, "r", 0, "ann", issue, "benchmarks run a/b"),
        (11, "r", 0, "ann", "https://x/issues/0", "benchmarks run a/b"),
    ]
    comments = spark.createDataFrame(
        [(*d, T0, T0 + timedelta(seconds=d[0])) for d in data],
        "comment_id bigint, repository string, queue bigint, login string, issue_url string, body string, created_at timestamp, updated_at timestamp",
    )
    outcomes = process_comments(
        comments,
        seen=spark.createDataFrame([(9,)], "comment_id bigint"),
        jobs=spark.createDataFrame([(10, None)], "comment_id bigint, status_comment_id bigint"),
        allow_list=spark.createDataFrame([("ann",)], "login string"),
        pull_requests=spark.createDataFrame([("r", 7, "u", "b", "h")], "repository string, number bigint, html_url string, base_sha string, head_sha string"),
        active=spark.createDataFrame([], "queue bigint, requested_by string, active bigint"),
        failures=spark.createDataFrame(
            [(7, 2, T0), (8, 1, T0 + timedelta(days=1))], "comment_id bigint, attempts bigint, next_attempt_at timestamp"
        ),
        polled_at=F.lit(T0 + timedelta(minutes=1)).cast("timestamp"),
    )
    found = {r["comment_id"]: r for r in outcomes.collect()}
    assert {k: r["outcome"] for k, r in found.items()} == {
        1: "queued", 2: "ignored_none", 3: "ignored_not_pr", 4: "ignored_unauthorised", 5: "invalid_reply", 6: "retry",
        7: "dropped", 8: "waiting", 9: "handled", 10: "status_comment", 11: "ignored_not_pr",
    }
    assert found[5]["reply"] == f"@ann {USAGE}"
    assert (found[6]["attempt"], found[6]["settled"], found[7]["settled"], found[8]["settled"]) == (1, False, True, False)
