"""Streaming jobs run over landed files, checked against their batch meaning."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, functions as F

from lapwise.contract.base import micros, query
from lapwise.contract.predicates import EXPECTED_COMMANDS
from lapwise.contract.workloads import PROCESSED
from lapwise.fixtures import Fixtures
from lapwise.functions.commands import parse_commands
from lapwise.operators import jobs
from lapwise.session import cut, work_dir
from lapwise.sources.feed import comment_stream, land_comments
from lapwise.sources.pages import PAGE_SIZE, feed_pages, land_pages, page_stream
from lapwise.streaming.comments import COMMENT_COLUMNS, CommentProcessor, dedupe_batch, run_available
from lapwise.streaming.jobs import REPORTED_EVENT, job_event_stream, run_job_state, run_progress, run_progress_messages
from lapwise.streaming.lifecycle import run_lifecycle
from lapwise.streaming.state import BatchLog

FIRST_POLL = datetime(2024, 2, 1, tzinfo=timezone.utc)


@query("stream_comments", f"""
SELECT comment_id, epoch_us(updated_at) AS updated_us, kind FROM ({EXPECTED_COMMANDS}) c
""")
def stream_comments(fx: Fixtures) -> DataFrame:
    """Landed pages, parsed by a stream into the file sink."""
    landing, out = work_dir(fx.spark, "landing"), work_dir(fx.spark, "parsed")
    land_comments(fx.comments(), landing, pages=4)
    parsed = parse_commands(comment_stream(fx.spark, landing, files_per_batch=2)).select(
        "comment_id", micros("updated_at").alias("updated_us"), "kind"
    )
    stream = (
        parsed.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", work_dir(fx.spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return fx.spark.read.schema(parsed.schema).parquet(out)


@query("stream_dedupe", "SELECT comment_id, body, epoch_us(updated_at) AS updated_us FROM fx_comments")
def stream_dedupe(fx: Fixtures) -> DataFrame:
    """Comments, then edits of a part of them, in two runs of one stream: edits change nothing."""
    landing, checkpoint = work_dir(fx.spark, "landing"), work_dir(fx.spark, "checkpoint")
    comments = fx.comments().select(*COMMENT_COLUMNS)
    edits = comments.where(F.col("comment_id") % 5 == 0).withColumns(
        {"body": F.lit("edited"), "updated_at": F.col("updated_at") + F.make_dt_interval(hours=F.lit(1))}
    )
    log = BatchLog(fx.spark, work_dir(fx.spark, "seen"), comments.schema)
    for landed in (comments.unionByName(edits), edits):
        land_comments(landed, landing)
        run_available(comment_stream(fx.spark, landing), dedupe_batch(log), checkpoint)
    return log.read().select("comment_id", "body", micros("updated_at").alias("updated_us"))


def _processor(fx: Fixtures, polls: list[datetime]) -> CommentProcessor:
    return CommentProcessor(
        fx.spark, work_dir(fx.spark, "state"), fx.allow_list(), fx.pull_requests(), now=lambda batch: polls[batch]
    )


# A stream starts without seen comments and jobs.
FRESH = PROCESSED.replace("p.comment_id % 13 = 0 OR j.comment_id IS NOT NULL", "j.comment_id IS NOT NULL").replace(
    "FROM fx_jobs) j", "FROM fx_jobs WHERE false) j"
)


@query("stream_admission", f"""
WITH {FRESH}
SELECT comment_id, decided AS outcome FROM final
""")
def stream_admission(fx: Fixtures) -> DataFrame:
    """Outcomes of one poll of the stream; equal to the batch job on the same comments."""
    landing = work_dir(fx.spark, "landing")
    land_comments(fx.comments(), landing, pages=3)
    processor = _processor(fx, [FIRST_POLL])
    processor.run(landing, work_dir(fx.spark, "checkpoint"))
    return processor.outcomes().select("comment_id", "outcome")


@query("stream_retry", f"""
WITH {FRESH},
failing AS (SELECT comment_id, CASE WHEN comment_id < (SELECT max(event_id) / 3 FROM events) THEN 0
                        WHEN comment_id < (SELECT 2 * (max(event_id) / 3) FROM events) THEN 1 ELSE 2 END AS page
            FROM final WHERE decided = 'retry')
SELECT comment_id, CAST(n AS BIGINT) AS attempt, CASE WHEN n = 3 THEN 'dropped' ELSE 'retry' END AS outcome,
       CASE WHEN n < 3 THEN epoch_us(TIMESTAMP '2024-02-01 00:00:00')
         + 1000000 * ([0, 60, 300][CAST(page + n AS INTEGER)] + CAST(30 * 2 ** (n - 1) AS BIGINT)) END AS next_us
FROM failing, generate_series(1, 3) g(n) WHERE page + n <= 3
""")
def stream_retry(fx: Fixtures) -> DataFrame:
    """Three polls: comments whose look-up keeps failing are retried, and dropped after the third time."""
    landing, checkpoint = work_dir(fx.spark, "landing"), work_dir(fx.spark, "checkpoint")
    comments = fx.comments()
    third = comments.agg(F.max("comment_id")).head()[0] / 3
    page = F.when(F.col("comment_id") < third, 0).when(F.col("comment_id") < 2 * third, 1).otherwise(2)
    paged = comments.withColumn("page", page)
    processor = _processor(fx, [FIRST_POLL + timedelta(seconds=s) for s in (0, 60, 300)])
    for number in range(3):
        land_comments(paged.where(F.col("page") == number).drop("page"), landing)
        processor.run(landing, checkpoint)
    return processor.outcomes().where("attempt IS NOT NULL").select(
        "comment_id", "attempt", "outcome", micros("next_attempt_at").alias("next_us")
    )


@query("stream_retry_idle", f"""
WITH {FRESH},
attempts(attempt, outcome, next_s) AS (VALUES (1, 'retry', 0 + 30), (2, 'retry', 60 + 60), (3, 'dropped', NULL))
SELECT comment_id, CAST(attempt AS BIGINT) AS attempt, attempts.outcome,
       epoch_us(TIMESTAMP '2024-02-01 00:00:00') + 1000000 * CAST(next_s AS BIGINT) AS next_us
FROM final, attempts WHERE decided = 'retry'
""")
def stream_retry_idle(fx: Fixtures) -> DataFrame:
    """Five polls, pages only at the first: due attempts are made without a new page, and by another process."""
    landing, polls, checkpoint, state = (work_dir(fx.spark, p) for p in ("landing", "polls", "checkpoint", "state"))
    land_comments(fx.comments(), landing)
    # Before the second attempt is due, when it is, when the third is, and afterwards.
    for seconds in (0, 10, 60, 300, 900):
        processor = CommentProcessor(fx.spark, state, fx.allow_list(), fx.pull_requests())
        processor.poll(landing, polls, checkpoint, FIRST_POLL + timedelta(seconds=seconds))
    return processor.outcomes().where("attempt IS NOT NULL").select(
        "comment_id", "attempt", "outcome", micros("next_attempt_at").alias("next_us")
    )


JOB_STATE = """
SELECT job_id, coalesce(max_by(CASE event WHEN 'queued' THEN 'pending' WHEN 'claim' THEN 'running' ELSE event END, (event_ts, event_id))
                          FILTER (event <> 'progress'), 'pending') AS status,
       count(*) FILTER (event = 'claim') AS attempts, epoch_us(max(event_ts)) AS updated_us
FROM fx_job_events GROUP BY 1
"""


@query("job_state", JOB_STATE)
def job_state(fx: Fixtures) -> DataFrame:
    state = jobs.job_state(fx.job_events())
    return state.select("job_id", "status", "attempts", micros("updated_at").alias("updated_us"))


def _land_events(fx: Fixtures, pages: int) -> str:
    landing = work_dir(fx.spark, "landing")
    exact = ("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    fx.job_events().repartitionByRange(pages, "event_ts").write.option(*exact).json(landing)
    return landing


@query("stream_job_state", JOB_STATE)
def stream_job_state(fx: Fixtures) -> DataFrame:
    """The same state folded batch by batch."""
    events = job_event_stream(fx.spark, _land_events(fx, 3), files_per_batch=2)
    state = run_job_state(fx.spark, events, work_dir(fx.spark, "state"), work_dir(fx.spark, "checkpoint"))
    return state.select("job_id", "status", "attempts", micros("updated_at").alias("updated_us"))


# Every fifth event is a restart, so that jobs are taken back and claimed again.
_RESTARTS = "event_id % 5 = 2"


@query("stream_job_lifecycle", f"""
WITH RECURSIVE ordered AS (
  SELECT job_id, CASE WHEN {_RESTARTS} THEN 'recover' ELSE event END AS event, step, epoch_us(event_ts) AS us,
         row_number() OVER (PARTITION BY job_id ORDER BY event_ts, event_id) AS n FROM fx_job_events),
folded(job_id, n, status, attempts, step, accepted, refused, updated_us) AS (
  SELECT DISTINCT job_id, CAST(0 AS BIGINT), 'new', CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM ordered
  UNION ALL
  SELECT job_id, n, coalesce(next, status), attempts + CASE WHEN next IS NOT NULL AND event = 'claim' THEN 1 ELSE 0 END,
         CASE WHEN next IS NULL THEN reached WHEN event = 'claim' THEN NULL WHEN event = 'progress' THEN step ELSE reached END,
         accepted + CASE WHEN next IS NULL THEN 0 ELSE 1 END, refused + CASE WHEN next IS NULL THEN 1 ELSE 0 END,
         CASE WHEN next IS NULL THEN updated_us ELSE us END
  FROM (SELECT o.job_id, o.n, f.status, f.attempts, f.step AS reached, o.step, f.accepted, f.refused, f.updated_us, o.us, o.event,
               CASE WHEN f.status = 'new' AND o.event = 'queued' THEN 'pending' WHEN f.status = 'pending' AND o.event = 'claim' THEN 'running'
                    WHEN f.status = 'running' AND o.event IN ('completed', 'failed') THEN o.event
                    WHEN f.status = 'running' AND o.event = 'progress' THEN 'running'
                    WHEN f.status = 'running' AND o.event = 'recover' THEN CASE WHEN f.attempts < 3 THEN 'pending' ELSE 'failed' END END AS next
        FROM folded f JOIN ordered o ON o.job_id = f.job_id AND o.n = f.n + 1) moved)
SELECT job_id, arg_max(status, n) AS status, arg_max(attempts, n) AS attempts, max_by(step, n) FILTER (last) AS step,
       max(accepted) AS accepted, max(refused) AS refused, CAST(0 AS BIGINT) AS late, max(updated_us) AS updated_us
FROM (SELECT *, n = max(n) OVER (PARTITION BY job_id) AS last FROM folded) f GROUP BY job_id
""")
def stream_job_lifecycle(fx: Fixtures) -> DataFrame:
    """Checked transitions; pages are dealt at random over the whole time, and the stream is restarted between them."""
    state, checkpoint, landing = (work_dir(fx.spark, p) for p in ("state", "checkpoint", "landing"))
    exact = ("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    events = fx.job_events().withColumn("event", F.when(F.expr(_RESTARTS), "recover").otherwise(F.col("event")))
    for part in (0, 1):
        shuffled = events.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part).repartition(2, F.xxhash64("event_id", "job_id"))
        shuffled.write.mode("append").option(*exact).json(landing)
        stream = job_event_stream(fx.spark, landing, files_per_batch=1)
        jobs_now = run_lifecycle(fx.spark, stream, state, checkpoint, lateness_seconds=400 * 86_400)
    return jobs_now


@query("stream_progress", """
SELECT job_id, CAST(max(step) AS BIGINT) AS step FROM fx_job_events WHERE event = 'progress' GROUP BY 1
""")
def stream_progress(fx: Fixtures) -> DataFrame:
    events = job_event_stream(fx.spark, _land_events(fx, 2))
    return run_progress(fx.spark, events, work_dir(fx.spark, "state"), work_dir(fx.spark, "checkpoint"))


# What the progress events report: a step of 6 + 2 datasets, and every seventh could not be published.
_REPORT = {"total": "CAST(6 + 2 * (job_id % 4) AS BIGINT)", "message": "'Step ' || step || ' of job ' || job_id", "published": "event_id % 7 <> 3"}


@query("stream_progress_messages", f"""
WITH reported AS (SELECT *, {", ".join(f"{e} AS {c}" for c, e in _REPORT.items())}, event = 'progress' AS progress,
       CASE event WHEN 'queued' THEN 'pending' WHEN 'claim' THEN 'running' ELSE event END AS next FROM fx_job_events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id, progress ORDER BY CASE WHEN progress THEN step END DESC, event_ts DESC, event_id DESC) AS place
           FROM reported)
SELECT job_id, CAST(max(step) FILTER (progress AND place = 1) AS BIGINT) AS step, max(total) FILTER (progress AND place = 1) AS total,
       max(message) FILTER (progress AND place = 1) AS message, bool_or(published) FILTER (progress AND place = 1) AS published,
       CAST(max(step) FILTER (progress AND published) AS BIGINT) AS shown_step,
       count(*) FILTER (progress AND NOT published) AS failed_publications,
       coalesce(max(next) FILTER (NOT progress AND place = 1), 'pending') AS status
FROM ranked GROUP BY job_id
""")
def stream_progress_messages(fx: Fixtures) -> DataFrame:
    """The last message of every job; failed publications stop no job, also over a restart."""
    landing, state, checkpoint = (work_dir(fx.spark, p) for p in ("landing", "state", "checkpoint"))
    exact = ("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    events = fx.job_events().withColumns({c: F.when(F.col("event") == "progress", F.expr(e)) for c, e in _REPORT.items()})
    for part in (1, 0):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part).repartition(2).write.mode("append").option(*exact).json(landing)
        stream = job_event_stream(fx.spark, landing, files_per_batch=1, schema=REPORTED_EVENT)
        messages = run_progress_messages(fx.spark, stream, state, checkpoint)
    return messages.select("job_id", "step", "total", "message", "published", "shown_step", "failed_publications", "status")


# The page of each repository that lands late.
_LATE_PAGE = 2


@query("stream_pages", f"""
SELECT comment_id, repository, page, epoch_us(updated_at) AS updated_us, CAST(CASE WHEN page < {_LATE_PAGE} THEN 1 ELSE 2 END AS BIGINT) AS poll
FROM (SELECT *, (row_number() OVER (PARTITION BY repository ORDER BY updated_at, comment_id) - 1) // {PAGE_SIZE} AS page FROM fx_comments) numbered
""")
def stream_pages(fx: Fixtures) -> DataFrame:
    """Every page once, with a restart in mid-feed: pages behind one that is not there yet wait for it."""
    landing, out, checkpoint = (work_dir(fx.spark, p) for p in ("landing", "pages", "checkpoint"))
    paged = cut(feed_pages(fx.comments()), "paged")
    late = F.col("page") == _LATE_PAGE
    for number, landed in enumerate((paged.where(~late), paged.where(late)), 1):
        land_pages(landed, landing)
        read = page_stream(fx.spark, landing).select(
            "comment_id", "repository", "page", micros("updated_at").alias("updated_us"), F.lit(number).cast("bigint").alias("poll")
        )
        sink = read.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        sink.trigger(availableNow=True).start().awaitTermination()
    return fx.spark.read.schema(read.schema).parquet(out)


@query("claim_next", """
SELECT j.id, CASE WHEN j.id = n.id THEN 'running' ELSE status END AS status,
       attempt_count + CASE WHEN j.id = n.id THEN 1 ELSE 0 END AS attempt_count
FROM fx_jobs j LEFT JOIN (SELECT min(id) AS id FROM fx_jobs WHERE status = 'pending' AND status_comment_id IS NOT NULL) n ON j.id = n.id
""")
def claim_next(fx: Fixtures) -> DataFrame:
    return jobs.claim_next(fx.jobs()).select("id", "status", "attempt_count")


@query("recover_running", """
SELECT id, CASE WHEN status = 'running' AND attempt_count < 3 THEN 'pending' WHEN status = 'running' THEN 'failed' ELSE status END AS status,
       CASE WHEN status = 'running' AND attempt_count >= 3 THEN 'Controller restarted during this job 3 times' END AS error
FROM fx_jobs
""")
def recover_running(fx: Fixtures) -> DataFrame:
    return jobs.recover_running(fx.jobs()).select("id", "status", "error")
