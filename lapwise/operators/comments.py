"""Handling of comments: what happens to each, and how far a feed is settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lapwise.functions.commands import parse_commands
from lapwise.functions.names import issue_number
from lapwise.functions.text import first_characters
from lapwise.operators.numbering import first_rows

# Retry and scan rules.
MAX_ATTEMPTS = 3
FIRST_DELAY_SECONDS = 30
LONGEST_DELAY_SECONDS = 300
ERROR_LENGTH = 4_000
SCAN_OVERLAP_SECONDS = 120
FIRST_LOOKBACK_SECONDS = 3_600


def authorised(comments: DataFrame, allow_list: DataFrame) -> DataFrame:
    """Comments whose author, in lower case, is on the allow-list (``login``)."""
    allowed = allow_list.select(F.col("login").alias("_login"))
    return comments.join(allowed, F.lower(comments["login"]) == F.col("_login"), "left_semi")


def with_handling(comments: DataFrame, seen: DataFrame, jobs: DataFrame) -> DataFrame:
    """Add ``_seen``, ``_has_job`` and ``_job_has_status``; ids are unique on all three sides."""
    known = seen.select("comment_id").distinct().withColumn("_seen", F.lit(True))
    existing = jobs.select("comment_id", F.col("status_comment_id").isNotNull().alias("_job_has_status"))
    joined = comments.join(known, "comment_id", "left").join(existing, "comment_id", "left")
    return joined.withColumn("_has_job", F.col("_job_has_status").isNotNull()).fillna(
        False, ["_seen", "_job_has_status"]
    )


def unhandled_comments(comments: DataFrame, seen: DataFrame, jobs: DataFrame) -> DataFrame:
    """Comments not seen yet, or seen with a job that still lacks its status comment."""
    done = F.col("_seen") & (~F.col("_has_job") | F.col("_job_has_status"))
    return with_handling(comments, seen, jobs).where(~done).select(*comments.columns)


def admission_eligible(comments: DataFrame, seen: DataFrame, jobs: DataFrame, allow_list: DataFrame) -> DataFrame:
    """Add the parsed command, ``number`` and the ``outcome`` of every comment.

    The first rule that applies decides: already handled, waiting for a status
    comment only, no command, not a pull request, author not allowed, command
    invalid (a reply), and otherwise a candidate for the queue.
    """
    allowed = allow_list.select(F.col("login").alias("_login"), F.lit(True).alias("_allowed"))
    # Parsed at the scan: what a caller does not read of a comment is not shuffled by the joins.
    parsed = parse_commands(comments).withColumn("number", issue_number(F.col("issue_url")))
    judged = with_handling(parsed, seen, jobs).join(allowed, F.lower("login") == F.col("_login"), "left")
    outcome = (
        F.when(F.col("_has_job") & ~F.col("_job_has_status"), "status_comment")
        .when(F.col("_seen") | F.col("_has_job"), "handled")
        .when(F.col("kind") == "none", "ignored_none")
        .when(F.col("number").isNull(), "ignored_not_pr")
        .when(F.col("_allowed").isNull(), "ignored_unauthorised")
        .when(F.col("kind") == "invalid", "invalid_reply")
        .otherwise("candidate")
    )
    return judged.withColumn("outcome", outcome).drop("_login", "_allowed", "_seen", "_has_job", "_job_has_status")


def attach_revisions(requests: DataFrame, pull_requests: DataFrame) -> DataFrame:
    """Add base and head revision by (repository, number); ``found`` is false where the look-up fails."""
    known = pull_requests.select(
        "repository", "number", F.col("html_url").alias("pull_request_url"), "base_sha", "head_sha"
    )
    return requests.join(known, ["repository", "number"], "left").withColumn("found", F.col("base_sha").isNotNull())


def retry_delay(attempt: Column) -> Column:
    """Seconds until the next attempt: doubling from 30 up to 300."""
    doubled = F.lit(FIRST_DELAY_SECONDS) * F.pow(F.lit(2.0), F.least(attempt, F.lit(16)) - 1)
    return F.least(F.lit(LONGEST_DELAY_SECONDS), doubled).cast("bigint")


def retry_schedule(failures: DataFrame) -> DataFrame:
    """Attempts of failing comments: when to try again, and after which one the comment is dropped.

    A comment is dropped after its third failure, so only the first three of
    each exist as attempts; the rank limit keeps a comment with very many
    failure rows small before the shuffle.
    """
    ranked = first_rows(failures, ["comment_id"], ["failed_at", "failure_id"], MAX_ATTEMPTS, "attempt")
    delay = retry_delay(F.col("attempt"))
    return ranked.select(
        "comment_id",
        F.col("attempt").cast("bigint").alias("attempt"),
        delay.alias("delay_seconds"),
        (F.col("failed_at") + F.make_dt_interval(secs=delay)).alias("next_attempt_at"),
        first_characters(F.col("error"), ERROR_LENGTH).alias("last_error"),
        (F.col("attempt") >= MAX_ATTEMPTS).alias("dropped"),
    )


def settled_watermark(comments: DataFrame, current: DataFrame, polled_at: Column) -> DataFrame:
    """How far each repository's feed may move on.

    The position is the newest update before the first unsettled comment, less
    the overlap; the poll time counts too if nothing is unsettled; a stored
    position never moves back.  Two map-side combined aggregations and a join
    with one row per repository; the feed is never ordered.
    """
    place = F.struct(F.col("updated_at"), F.col("comment_id"))
    # Only unsettled rows, a small share of a feed, are compared by two columns.
    blocked = comments.where(~F.col("settled")).groupBy("repository").agg(F.min(place).alias("_blocked"))
    prefix = F.col("settled") & (F.col("_blocked").isNull() | (place < F.col("_blocked")))
    overlap = F.make_dt_interval(secs=F.lit(SCAN_OVERLAP_SECONDS))
    reached = (
        comments.join(blocked, "repository", "left")
        .groupBy("repository")
        .agg(
            F.max(F.when(prefix, F.col("updated_at"))).alias("_newest"),
            F.bool_and("settled").alias("_all"),
        )
    )
    position = F.greatest(
        F.col("_newest") - overlap,
        F.when(F.col("_all"), polled_at - overlap),
        F.col("scanned_through"),
    )
    return reached.join(current.select("repository", "scanned_through"), "repository", "full_outer").select(
        "repository", position.alias("scanned_through")
    )


def advance_scan_state(current: DataFrame, observed: DataFrame) -> DataFrame:
    """Per-repository positions that only ever grow."""
    return (
        current.select("repository", "scanned_through")
        .unionByName(observed.select("repository", "scanned_through"))
        .groupBy("repository")
        .agg(F.max("scanned_through").alias("scanned_through"))
    )


def scan_start(state: DataFrame, polled_at: Column) -> DataFrame:
    """Where the next scan of each repository starts: its position, or an hour back at first."""
    first = polled_at - F.make_dt_interval(secs=F.lit(FIRST_LOOKBACK_SECONDS))
    return state.select("repository", F.coalesce("scanned_through", first).alias("since"))


def first_versions(comments: DataFrame) -> DataFrame:
    """The first version of every comment; edits of a comment are not new requests.

    A struct minimum combines map-side, so repeated copies of one comment
    never gather in one task.
    """
    others = [c for c in comments.columns if c not in ("comment_id", "updated_at")]
    first = F.min(F.struct("updated_at", *others)).alias("first")
    return comments.groupBy("comment_id").agg(first).select("comment_id", "first.*").select(*comments.columns)
