"""Streams against their batch meaning, also when run again."""

import os
import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from conftest import rows
from lapwise import session
from lapwise.fixtures import Fixtures
from lapwise.operators.jobs import job_state
from lapwise.sources.feed import comment_stream, land_comments
from lapwise.streaming.comments import CommentProcessor, dedupe_batch, run_available
from lapwise.streaming.jobs import job_event_stream, run_job_state
from lapwise.sources.commits import CommitConflict, Commits
from lapwise.streaming.lifecycle import apply_event, run_lifecycle
from lapwise.streaming.state import BatchLog, CurrentTable, SeenIds, Writer, latest_rows

T0 = datetime(2024, 2, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def fx(spark, sf_dir):
    return Fixtures(spark, sf_dir)


def test_a_batch_run_again_changes_nothing(spark, fx, tmp_path):
    comments = fx.comments().drop("settled")
    log = BatchLog(spark, f"{tmp_path}/log", comments.schema)
    handle = dedupe_batch(log)
    first, second = comments.where("comment_id < 600"), comments.where("comment_id >= 300")
    handle(first, 0)
    handle(second, 1)
    before = rows(log.read(), "comment_id", "batch")
    handle(second, 1)  # as after a failure between the write and the commit
    assert rows(log.read(), "comment_id", "batch") == before
    assert len(before) == comments.count()


def test_restart_continues_where_it_stopped(spark, fx, tmp_path):
    comments = fx.comments()
    processor = CommentProcessor(
        spark, f"{tmp_path}/state", fx.allow_list(), fx.pull_requests(),
        now=lambda batch: T0 + timedelta(hours=batch),
    )
    for part in (0, 1):
        land_comments(comments.where(F.col("comment_id") % 2 == part), f"{tmp_path}/landing")
        processor.run(f"{tmp_path}/landing", f"{tmp_path}/checkpoint")
        processor.run(f"{tmp_path}/landing", f"{tmp_path}/checkpoint")
    outcomes = processor.outcomes()
    settled = outcomes.where("settled").groupBy("comment_id").count()
    assert settled.where("count > 1").isEmpty()
    assert outcomes.select("comment_id").distinct().count() == comments.count()
    queued = outcomes.where("outcome = 'queued'").groupBy("queue").count()
    assert queued.agg(F.max("count")).head()[0] <= 20
    per_user = outcomes.where("outcome = 'queued'").groupBy("queue", "login").count()
    assert per_user.agg(F.max("count")).head()[0] <= 3
    # unsettled look-ups hold their repository's position back
    current = comments.select("repository").distinct().withColumn("scanned_through", F.lit("2023-12-01").cast("timestamp"))
    marks = processor.watermark(current, F.lit(T0).cast("timestamp"))
    held = outcomes.where("NOT settled").groupBy("repository").agg(F.min("updated_at").alias("open"))
    assert marks.join(held, "repository").where("scanned_through >= open").isEmpty()


def test_job_state_over_several_batches(spark, fx, tmp_path):
    events = fx.job_events()
    exact = ("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).write.mode("append").option(*exact).json(f"{tmp_path}/landing")
        stream = job_event_stream(spark, f"{tmp_path}/landing")
        state = run_job_state(spark, stream, f"{tmp_path}/state", f"{tmp_path}/checkpoint")
    assert rows(state, "job_id", "status", "attempts") == rows(job_state(events), "job_id", "status", "attempts")


def test_latest_rows(spark):
    log = spark.createDataFrame([(1, "a", 0), (1, "b", 2), (2, "c", 1)], "k int, v string, batch bigint")
    assert rows(latest_rows(log, ["k"])) == [(1, "b"), (2, "c")]


def test_a_batch_reads_current_state_only(spark, fx, tmp_path):
    """After any number of batches a batch opens one version of a table."""
    path = f"{tmp_path}/t"
    table = CurrentTable(spark, path, spark.range(0).schema)
    for batch in range(4):
        table.write(table.read(batch).unionByName(spark.range(batch, batch + 1)), batch)
    assert sorted(f for f in os.listdir(path) if f.startswith("batch=")) == ["batch=2", "batch=3"]
    assert rows(table.read(4)) == [(0,), (1,), (2,), (3,)] and rows(table.read(3)) == [(0,), (1,), (2,)]


def _ids(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "comment_id bigint")


def test_seen_ids_are_compacted_bitmaps(spark, tmp_path):
    """Fifty batches of ids near and far, below zero and at the borders of ranges, one of them run again."""
    seen, rng, known = SeenIds(spark, f"{tmp_path}/seen", compact_every=4), random.Random(2), set()
    for batch in range(50):
        own = {rng.choice([1, 32_768, 32_769, -1, -32_768, 10**12]) + rng.randrange(3) * batch for _ in range(4)}
        asked = own | set(rng.sample(sorted(known), min(3, len(known))))
        if batch % 7 == 3:
            assert {r[0] for r in rows(seen.unseen(_ids(spark, asked), batch))} == asked - known, batch
        for _ in range(2 if batch in (19, 21) else 1):
            seen.write(_ids(spark, [*own, None]), batch)
        known |= own
    assert rows(SeenIds(spark, f"{tmp_path}/seen", compact_every=4).unseen(_ids(spark, [*known, 5_000_000, None]), 50)) == [(None,), (5_000_000,)]
    kinds = {k: os.listdir(f"{tmp_path}/seen/kind={k}") for k in ("base", "delta")}
    assert len(kinds["base"]) <= 2 and len([d for d in kinds["delta"] if d.startswith("batch=")]) <= 10
    one = SeenIds(spark, f"{tmp_path}/seen", compact_every=4)._before(48)
    assert one.groupBy("bucket").count().where("count > 1").isEmpty()


def test_one_writer_commits_a_batch(spark, fx, tmp_path):
    """A second processor takes over: the first fails at its next batch, and nothing it wrote meanwhile is read."""
    make = lambda: CommentProcessor(spark, f"{tmp_path}/state", fx.allow_list(), fx.pull_requests(), now=lambda b: T0 + timedelta(hours=b))
    comments = fx.comments()
    first = make()
    first.handle(comments.where("comment_id < 300"), 0)
    before = rows(first.outcomes(), "comment_id", "outcome")
    # the first writes its next batch but is overtaken before it commits
    first.writer.begin(1)
    first.log.write(first.log.read_batch(0).withColumn("outcome", F.lit("never")), 1)
    second = make()
    assert rows(second.outcomes(), "comment_id", "outcome") == before
    with pytest.raises(CommitConflict, match="Another processor"):
        first.handle(comments.where("comment_id >= 300"), 1)
    second.handle(comments.where("comment_id >= 300 AND comment_id < 500"), 1)
    with pytest.raises(CommitConflict):
        first.writer.commit(1)
    outcomes = second.outcomes()
    assert outcomes.where("outcome = 'never'").isEmpty() and outcomes.select("comment_id").distinct().count() == comments.where("comment_id < 500").count()
    # a batch that is committed is not done again, and an older one is an error
    second.handle(comments, 1)
    assert second.outcomes().count() == outcomes.count()
    with pytest.raises(CommitConflict, match="ahead"):
        second.handle(comments, 0)


def test_a_crash_between_tables_leaves_the_last_batch(spark, fx, tmp_path, monkeypatch):
    make = lambda: CommentProcessor(spark, f"{tmp_path}/state", fx.allow_list(), fx.pull_requests(), now=lambda b: T0 + timedelta(hours=b))
    comments = fx.comments()
    processor = make()
    processor.handle(comments.where("comment_id < 300"), 0)
    with monkeypatch.context() as crash:
        crash.setattr(SeenIds, "write", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError, match="crash"):
            processor.handle(comments.where("comment_id >= 300"), 1)
    again = make()
    assert again.outcomes().where("batch > 0").isEmpty()
    again.handle(comments.where("comment_id >= 300"), 1)
    whole = make()
    plain = CommentProcessor(spark, f"{tmp_path}/other", fx.allow_list(), fx.pull_requests(), now=lambda b: T0 + timedelta(hours=b))
    plain.handle(comments.where("comment_id < 300"), 0)
    plain.handle(comments.where("comment_id >= 300"), 1)
    columns = ("comment_id", "outcome", "attempt", "batch")
    assert rows(whole.outcomes(), *columns) == rows(plain.outcomes(), *columns)
    assert rows(whole.active.read(2)) == rows(plain.active.read(2))


def test_commits(spark, tmp_path):
    commits = Commits(spark, f"{tmp_path}/c")
    assert commits.latest() is None and commits.read(0) is None and commits.numbers() == []
    commits.commit(0, {"a": 1})
    commits.commit(1, {"a": "é"})
    with pytest.raises(CommitConflict):
        Commits(spark, f"{tmp_path}/c").commit(1, {"a": 3})
    assert commits.latest() == (1, {"a": "é"}) and commits.numbers() == [0, 1]
    commits.forget(1)
    assert commits.numbers() == [1]
    assert [Writer(spark, f"{tmp_path}/w").epoch for _ in range(3)] == [0, 1, 2]


def test_attempts_go_on_without_pages(spark, fx, tmp_path, monkeypatch):
    """A watch retries at every poll, though no page has landed since the first."""
    monkeypatch.setattr("lapwise.operators.comments.FIRST_DELAY_SECONDS", 0)
    failing = fx.comments().limit(1).withColumns(
        {"body": F.lit("benchmarks run tpch/sf1"), "login": F.lit("User1"), "issue_url": F.lit("https://api.example.org/repos/o/r/issues/7")}
    )
    land_comments(failing, f"{tmp_path}/landing")
    nobody = fx.pull_requests().where("number IS NULL")
    processor = CommentProcessor(spark, f"{tmp_path}/state", spark.createDataFrame([("user1",)], "login string"), nobody)
    query = processor.watch(f"{tmp_path}/landing", f"{tmp_path}/checkpoint", "1 second")
    try:
        deadline = time.time() + 120
        while time.time() < deadline and processor.outcomes().where("outcome = 'dropped'").isEmpty():
            assert query.exception() is None
            time.sleep(1)
    finally:
        query.stop()
    assert rows(processor.outcomes(), "attempt", "outcome") == [(1, "retry"), (2, "retry"), (3, "dropped")]


def _fold(events):
    state = ("new", 0, None, 0, 0, 0, None)
    for us, _, event, step in sorted(events):
        state = apply_event(state, us, event, step)
    return state


def test_transitions_are_checked():
    follow = lambda *names: _fold([(i, i, n, i) for i, n in enumerate(names)])[:5]
    assert follow("queued", "claim", "completed") == ("completed", 1, None, 3, 0)
    assert follow("queued", "claim", "completed", "claim", "queued", "failed", "progress") == ("completed", 1, None, 3, 4)
    assert follow("claim", "completed") == ("new", 0, None, 0, 2)
    assert follow("queued", "completed", "claim", "progress") == ("running", 1, 3, 3, 1)
    taken_back = ["queued", "claim", "progress", "recover", "claim", "recover", "claim", "recover"]
    assert follow(*taken_back[:4]) == ("pending", 1, 2, 4, 0) and follow(*taken_back[:5])[:3] == ("running", 2, None)
    assert follow(*taken_back) == ("failed", 3, None, 8, 0)


def test_lifecycle_settles_what_is_old(spark, tmp_path):
    """Events out of order within the lateness count in their order; later ones are counted and change nothing."""
    schema = "job_id long, event_id long, event_ts timestamp, event string, step long"
    event = lambda job, second, name: (job, second, T0 + timedelta(seconds=second), name, None)
    pages = [
        [event(1, 10, "claim"), event(1, 0, "queued"), event(2, 5, "queued"), (2, 1, None, "claim", None)],
        [event(1, 30, "completed"), event(1, 20, "progress"), event(2, 100, "claim")],
        [event(2, 6, "claim"), event(2, 99, "failed"), event(2, 3, "progress"), event(1, 25, "recover")],
    ]
    exact = ("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    for page in pages:
        spark.createDataFrame(page, schema).coalesce(1).write.mode("append").option(*exact).json(f"{tmp_path}/landing")
        stream = job_event_stream(spark, f"{tmp_path}/landing")
        state = run_lifecycle(spark, stream, f"{tmp_path}/state", f"{tmp_path}/checkpoint", lateness_seconds=60)
    found = {r["job_id"]: tuple(r)[1:7] for r in state.collect()}
    assert found[1] == ("pending", 1, None, 4, 1, 0)
    # the claim at 6 comes before the failure at 99, and the one at 100 is refused; 3 lies before what is settled
    assert found[2] == ("failed", 1, None, 3, 1, 2)


def test_work_of_a_batch_is_removed(spark, fx, tmp_path, monkeypatch):
    removed, remove = [], session.remove_folder
    monkeypatch.setattr(session, "remove_folder", lambda spark, path: (remove(spark, path), removed.append(path)))
    processor = CommentProcessor(spark, f"{tmp_path}/state", fx.allow_list(), fx.pull_requests(), now=lambda batch: T0)
    processor.handle(fx.comments(), 0)
    assert processor.outcomes().count() == fx.comments().count()
    assert removed and not any(session.folder_exists(spark, path) for path in removed)


def test_pages_are_written_by_several_tasks(spark, tmp_path):
    stamp = "timestamp_micros(id) AS {0}"
    comments = spark.range(200_000).selectExpr(
        "id AS comment_id", "'o/r' AS repository", "id AS queue", "'a' AS login", "'u' AS issue_url", "sha2(CAST(id AS STRING), 512) AS body",
        stamp.format("created_at"), stamp.format("updated_at"),
    )
    land_comments(comments, f"{tmp_path}/landing")
    assert len(list((tmp_path / "landing").glob("part-*"))) > 1
    assert spark.read.json(f"{tmp_path}/landing").select("id").distinct().count() == 200_000
