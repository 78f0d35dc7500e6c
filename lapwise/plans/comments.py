"""What one poll of a comment feed decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lapwise.operators.admission import admit_requests
from lapwise.operators.comments import (
    MAX_ATTEMPTS,
    admission_eligible,
    attach_revisions,
    retry_delay,
)
from lapwise.session import cut

# Outcomes after which a comment is looked at again; all others settle it.
UNSETTLED = ("retry", "waiting", "status_comment")
# Replies to requests that are not queued.
LIMIT_REPLIES = {
    "queue_full": "The benchmark queue is full; this request was not queued.",
    "requester_limit": "The requester already has three active jobs; this request was not queued.",
}
OUTCOME_COLUMNS = (
    "comment_id", "repository", "queue", "login", "issue_url", "body", "created_at", "updated_at", "number",
    "datasets", "instance_type", "nodes", "pull_request_url", "base_sha", "head_sha", "outcome", "reply",
    "attempt", "next_attempt_at", "settled",
)


def process_comments(
    comments: DataFrame,
    seen: DataFrame,
    jobs: DataFrame,
    allow_list: DataFrame,
    pull_requests: DataFrame,
    active: DataFrame,
    failures: DataFrame,
    polled_at: Column,
) -> DataFrame:
    """Outcome of every comment of a poll.

    Candidates are looked up first; a failed look-up is retried with growing
    delays and dropped after the third attempt.  The others are admitted in
    the order of their updates.  ``failures`` holds ``comment_id, attempts,
    next_attempt_at`` of comments that failed before.
    """
    eligible = admission_eligible(comments, seen, jobs, allow_list)
    looked_up = attach_revisions(eligible, pull_requests)
    tried = looked_up.join(
        failures.select("comment_id", F.col("attempts").alias("_before"), F.col("next_attempt_at").alias("_due")),
        "comment_id", "left",
    )
    candidate = F.col("outcome") == "candidate"
    waiting = candidate & F.coalesce(F.col("_due") > polled_at, F.lit(False))
    failing = candidate & ~waiting & ~F.col("found")
    attempt = F.coalesce("_before", F.lit(0)) + 1
    staged = tried.withColumn(
        "_stage",
        F.when(waiting, "waiting")
        .when(failing, F.when(attempt >= MAX_ATTEMPTS, "dropped").otherwise("retry"))
        .when(candidate, "request")
        .otherwise(F.col("outcome")),
    ).withColumn("_attempt", F.when(failing, attempt).cast("bigint"))
    # Admission reads the requests twice and the outcome everything once more:
    # parsing and look-ups are done once, for all of them.
    staged = cut(staged, "staged")

    requests = staged.where(F.col("_stage") == "request").select(
        "queue", F.col("login").alias("requested_by"), "comment_id", F.col("updated_at").alias("arrived_at")
    )
    decided = admit_requests(requests, active).select("comment_id", "decision")
    outcome = F.when(
        F.col("_stage") == "request", F.when(F.col("decision") == "admitted", "queued").otherwise(F.col("decision"))
    ).otherwise(F.col("_stage"))
    judged = staged.join(decided, "comment_id", "left").withColumn("outcome", outcome)
    mention = F.concat(F.lit("@"), "login", F.lit(" "))
    reply = F.when(F.col("outcome") == "invalid_reply", F.concat(mention, "message"))
    for limit, text in LIMIT_REPLIES.items():
        reply = reply.when(F.col("outcome") == limit, F.concat(mention, F.lit(text)))
    delay = F.make_dt_interval(secs=retry_delay(F.col("_attempt")))
    return judged.withColumns(
        {
            "reply": reply,
            "attempt": F.col("_attempt"),
            "next_attempt_at": F.when(F.col("outcome") == "retry", polled_at + delay),
            "settled": ~F.col("outcome").isin(*UNSETTLED),
        }
    ).select(*OUTCOME_COLUMNS)
