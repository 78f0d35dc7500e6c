"""Job tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lapwise.functions.documents import dataset_list
from lapwise.functions.commands import DEFAULT_INSTANCE_TYPE, DEFAULT_NODES

ACTIVE = ("pending", "running")
MAX_CLAIMS = 3
PROGRESS_MESSAGES = {
    "base_checkout": "Checking out the base revision",
    "validation": "Validating all requested datasets",
    "base_deploy": "Deploying the base revision",
    "base_benchmark": "Benchmarking base: ",
    "head_checkout": "Checking out the PR-head revision",
    "head_deploy": "Deploying the PR-head revision",
    "head_benchmark": "Benchmarking PR head: ",
    "cleanup": "Destroying the benchmark deployment",
}
REQUIRED_LEGACY_COLUMNS = (
    "id", "comment_id", "repository", "pull_request_number", "pull_request_url", "requested_by", "dataset",
    "base_sha", "head_sha", "status", "error", "created_at", "updated_at",
)


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Active jobs in total (``requested_by`` null) and per requester, from one aggregation."""
    return (
        jobs.where(F.col("status").isin(*ACTIVE))
        .rollup("requested_by")
        .agg(F.count(F.lit(1)).alias("active"))
    )


def next_pending(jobs: DataFrame, limit: int = 1) -> DataFrame:
    """The oldest pending jobs that already have a status comment."""
    ready = (F.col("status") == "pending") & F.col("status_comment_id").isNotNull()
    return jobs.where(ready).orderBy("id").limit(limit)


def claim_next(jobs: DataFrame) -> DataFrame:
    """The job table after the next pending job was claimed: running, one more attempt."""
    claimed = next_pending(jobs).select("id", F.lit(True).alias("_claimed"))
    hit = F.coalesce(F.col("_claimed"), F.lit(False))
    return jobs.join(F.broadcast(claimed), "id", "left").select(  # one row
        *[c for c in jobs.columns if c not in ("status", "attempt_count")],
        F.when(hit, "running").otherwise(F.col("status")).alias("status"),
        (F.col("attempt_count") + hit.cast("bigint")).alias("attempt_count"),
    ).select(*jobs.columns)


def recover_running(jobs: DataFrame, max_claims: int = MAX_CLAIMS) -> DataFrame:
    """The job table after a restart: running jobs go back to pending, or fail after too many claims."""
    running = F.col("status") == "running"
    retry = running & (F.col("attempt_count") < max_claims)
    error = F.col("error") if "error" in jobs.columns else F.lit(None).cast("string")
    message = F.lit(f"Controller restarted during this job {max_claims} times")
    changed = jobs.withColumn(
        "_error", F.when(retry, F.lit(None)).when(running, message).otherwise(error)
    ).withColumn("status", F.when(retry, "pending").when(running, "failed").otherwise(F.col("status")))
    return changed.drop("error").withColumnRenamed("_error", "error")


def job_status_counts(jobs: DataFrame, max_claims: int = MAX_CLAIMS) -> DataFrame:
    """Jobs by status, and how many of them a recovery would retry or fail."""
    running = F.col("status") == "running"
    return jobs.groupBy("status").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(running & (F.col("attempt_count") < max_claims)).alias("retried"),
        F.count_if(running & (F.col("attempt_count") >= max_claims)).alias("failed"),
    )


def orphan_jobs(jobs: DataFrame, seen: DataFrame) -> DataFrame:
    """Jobs whose comment was never marked as seen."""
    return jobs.join(seen.select("comment_id").distinct(), "comment_id", "left_anti")


def normalize_datasets(jobs: DataFrame) -> DataFrame:
    """Job rows with a valid JSON array of dataset names."""
    return jobs.withColumn("datasets_json", dataset_list(F.col("datasets_json"), F.col("dataset")))


def legacy_columns(jobs: DataFrame, required: tuple[str, ...] = REQUIRED_LEGACY_COLUMNS) -> DataFrame:
    """Old job rows with the columns added since, holding their defaults."""
    missing = [c for c in required if c not in jobs.columns]
    if missing:
        raise ValueError(f"Not an old job table, it has no {', '.join(missing)}")
    added = {
        "attempt_count": F.lit(0).cast("bigint"),
        "benchmark_instance_type": F.lit(DEFAULT_INSTANCE_TYPE),
        "benchmark_node_count": F.lit(DEFAULT_NODES).cast("bigint"),
        "status_comment_id": F.lit(None).cast("bigint"),
        "datasets_json": F.lit(None).cast("string"),
    }
    absent = {name: value for name, value in added.items() if name not in jobs.columns}
    return normalize_datasets(jobs.withColumns(absent) if absent else jobs)


def progress_steps(jobs: DataFrame, keys: tuple[str, ...] = ("id",), datasets: str = "datasets") -> DataFrame:
    """All steps of every job with their messages: six fixed ones and two per dataset."""
    fixed = lambda *names: F.array(*[F.lit(PROGRESS_MESSAGES[n]) for n in names])
    each = lambda name: F.transform(F.col(datasets), lambda d: F.concat(F.lit(PROGRESS_MESSAGES[name]), d))
    steps = F.concat(
        fixed("base_checkout", "validation", "base_deploy"), each("base_benchmark"),
        fixed("head_checkout", "head_deploy"), each("head_benchmark"), fixed("cleanup"),
    )
    total = (F.size(datasets) * 2 + 6).cast("bigint")
    return jobs.select(*keys, total.alias("total"), F.posexplode(steps).alias("_pos", "message")).select(
        *keys, (F.col("_pos") + 1).cast("bigint").alias("step"), "total", "message"
    )


def _status() -> Column:
    """The status that a life-cycle event leads to; null for progress."""
    return (
        F.when(F.col("event") == "queued", "pending")
        .when(F.col("event") == "claim", "running")
        .when(F.col("event").isin("completed", "failed"), F.col("event"))
    )


def job_state(events: DataFrame) -> DataFrame:
    """Current state of every job from its life-cycle events.

    Progress does not change the state; every claim counts as an attempt.
    """
    place = F.struct("event_ts", "event_id")
    status = _status()
    last = F.max(F.when(status.isNotNull(), F.struct(place.alias("place"), status.alias("status"))))
    return events.groupBy("job_id").agg(
        F.coalesce(last["status"], F.lit("pending")).alias("status"),
        F.count_if(F.col("event") == "claim").alias("attempts"),
        F.max("event_ts").alias("updated_at"),
    )


def latest_progress(events: DataFrame) -> DataFrame:
    """The furthest step each job has reported."""
    return events.where(F.col("event") == "progress").groupBy("job_id").agg(F.max("step").alias("step"))


def progress_messages(events: DataFrame) -> DataFrame:
    """The furthest progress of each job with its message, and what of it was published.

    ``shown_step`` is the furthest step whose publication worked.  One that failed is
    counted and changes nothing else: ``status`` follows from the life-cycle events alone.
    """
    progress = F.col("event") == "progress"
    report = F.struct("step", "event_ts", "event_id", "total", "message", "published")
    last = F.max(F.when(progress, report))
    status = F.max(F.when(_status().isNotNull(), F.struct("event_ts", "event_id", _status().alias("status"))))
    return events.groupBy("job_id").agg(
        *[last[c].alias(c) for c in ("step", "total", "message", "published")],
        F.max(F.when(progress & F.col("published"), F.col("step"))).alias("shown_step"),
        F.count_if(progress & ~F.col("published")).alias("failed_publications"),
        F.coalesce(status["status"], F.lit("pending")).alias("status"),
    )


def queue_wait(jobs: DataFrame) -> DataFrame:
    """Milliseconds between request and last update, never negative."""
    wait = F.unix_millis("updated_at") - F.unix_millis("created_at")
    return jobs.withColumn("queue_wait_ms", F.greatest(F.lit(0).cast("bigint"), wait))
