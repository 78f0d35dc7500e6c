"""Admission of requests to bounded queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapwise.operators.numbering import first_rows

# Active jobs per queue and per requester.
QUEUE_LIMIT = 20
REQUESTER_LIMIT = 3


def admit_requests(
    requests: DataFrame,
    active: DataFrame,
    queue_limit: int = QUEUE_LIMIT,
    requester_limit: int = REQUESTER_LIMIT,
) -> DataFrame:
    """Add ``decision``: admitted, requester_limit or queue_full, as if decided one by one in arrival order.

    ``requests`` has ``queue, requested_by, comment_id`` and ``arrived_at``;
    ``active`` the pending and running jobs per ``queue, requested_by``.  While
    no job ends, the free places of a queue go to its first requests that are
    within their requester's limit.  Both steps keep a literal number of rows
    per group, so a queue or requester with a large share of all requests is
    cut down in every task before anything is shuffled; the decisions are then
    joined back by queue.
    """
    order = [F.col("arrived_at"), F.col("comment_id")]
    used = active.groupBy("queue", "requested_by").agg(F.sum("active").alias("_used"))
    queue_used = active.groupBy("queue").agg(F.sum("active").alias("_queue_used"))

    ranked = first_rows(
        requests.select("queue", "requested_by", "comment_id", "arrived_at"),
        ["queue", "requested_by"], order, requester_limit, "_rank",
    )
    own_places = F.lit(requester_limit) - F.coalesce("_used", F.lit(0))
    candidates = (
        ranked.join(used, ["queue", "requested_by"], "left")
        .where(F.col("_rank") <= own_places)
        .select("queue", "comment_id", "arrived_at")
    )
    places = F.lit(queue_limit) - F.coalesce("_queue_used", F.lit(0))
    admitted = (
        first_rows(candidates, ["queue"], order, queue_limit, "_place")
        .join(queue_used, "queue", "left")
        .where(F.col("_place") <= places)
        .select("queue", "comment_id", "arrived_at", (F.col("_place") == places).alias("_last"))
    )
    # One row per queue: the ids admitted, ``queue_limit`` at most, and the request that takes the last place.
    place = F.struct("arrived_at", "comment_id")
    by_queue = admitted.groupBy("queue").agg(
        F.collect_list("comment_id").alias("_admitted"), F.max(F.when(F.col("_last"), place)).alias("_closed_after")
    )
    full = queue_used.where(F.col("_queue_used") >= queue_limit).select("queue", F.lit(True).alias("_full"))
    queues = by_queue.join(full, "queue", "full_outer")

    # Without free places a queue was never open.
    closed = F.coalesce(F.col("_full"), F.lit(False)) | F.coalesce(place > F.col("_closed_after"), F.lit(False))
    decision = (
        F.when(F.array_contains("_admitted", F.col("comment_id")), "admitted")
        .when(closed, "queue_full")
        .otherwise("requester_limit")
    )
    return (
        requests.join(queues, "queue", "left")
        .withColumn("decision", decision)
        .drop("_admitted", "_closed_after", "_full")
    )


def active_by_requester(jobs: DataFrame, queue: str = "queue") -> DataFrame:
    """Pending and running jobs per queue and requester."""
    return (
        jobs.where(F.col("status").isin("pending", "running"))
        .groupBy(queue, "requested_by")
        .agg(F.count(F.lit(1)).alias("active"))
    )
