"""Streaming comment handling over landed feed pages."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from lapwise.operators.comments import first_versions, settled_watermark
from lapwise.plans.comments import process_comments
from lapwise.session import scratch
from lapwise.sources.feed import comment_stream, land_poll, poll_stream
from lapwise.streaming.state import BatchLog, CurrentTable, SeenIds, Writer

OUTCOME_LOG = T.StructType(
    [
        T.StructField("comment_id", T.LongType()),
        T.StructField("repository", T.StringType()),
        T.StructField("queue", T.LongType()),
        T.StructField("login", T.StringType()),
        T.StructField("issue_url", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("number", T.LongType()),
        T.StructField("datasets", T.ArrayType(T.StringType())),
        T.StructField("instance_type", T.StringType()),
        T.StructField("nodes", T.LongType()),
        T.StructField("pull_request_url", T.StringType()),
        T.StructField("base_sha", T.StringType()),
        T.StructField("head_sha", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("reply", T.StringType()),
        T.StructField("attempt", T.LongType()),
        T.StructField("next_attempt_at", T.TimestampType()),
        T.StructField("settled", T.BooleanType()),
    ]
)
COMMENT_COLUMNS = ["comment_id", "repository", "queue", "login", "issue_url", "body", "created_at", "updated_at"]


WAITING = T.StructType(
    [
        *[f for f in OUTCOME_LOG if f.name in COMMENT_COLUMNS],
        T.StructField("attempts", T.LongType()),
        T.StructField("next_attempt_at", T.TimestampType()),
    ]
)
ACTIVE = T.StructType(
    [
        T.StructField("comment_id", T.LongType()),
        T.StructField("queue", T.LongType()),
        T.StructField("requested_by", T.StringType()),
    ]
)


def dedupe_batch(log: BatchLog) -> Callable[[DataFrame, int], None]:
    """Batch function that logs every comment once, in its first version."""
    seen = SeenIds(log.spark, f"{log.path}-ids")

    def handle(batch: DataFrame, batch_id: int) -> None:
        log.write(seen.unseen(first_versions(batch), batch_id), batch_id)
        seen.write(log.read_batch(batch_id), batch_id)

    return handle


class CommentProcessor:
    """Handles landed comments batch by batch.

    What a batch needs of the past are three tables: the comments waiting for
    another attempt and the active jobs, both as they stand, and the ids seen,
    of which it opens the ranges of its own ids.  The outcome log is written
    and never read by a batch.  All of them count once their batch is
    committed, which one processor at a time can do (:class:`Writer`).

    Polls are a stream of their own beside the pages: a poll makes a batch even
    if no page has landed, so attempts that are due are made, and the time of a
    poll is the same when its batch is run again.
    """

    def __init__(
        self,
        spark: SparkSession,
        state: str,
        allow_list: DataFrame,
        pull_requests: DataFrame,
        finished: Callable[[], DataFrame] | None = None,
        now: Callable[[int], datetime] = lambda _: datetime.now(timezone.utc),
    ):
        self.spark, state = spark, state.rstrip("/")
        self.writer = Writer(spark, state)
        self.log = BatchLog(spark, f"{state}/outcomes", OUTCOME_LOG, self.writer)
        self.waiting = CurrentTable(spark, f"{state}/waiting", WAITING, self.writer)
        self.active = CurrentTable(spark, f"{state}/active", ACTIVE, self.writer)
        self.seen = SeenIds(spark, f"{state}/seen", self.writer)
        self.allow_list, self.pull_requests = allow_list, pull_requests
        self.finished, self.now = finished, now

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        if not self.writer.begin(batch_id):
            return
        polled_at = F.lit(self._polled_at(batch, batch_id)).cast("timestamp")
        if "polled_at" in batch.columns:
            batch = batch.where("polled_at IS NULL")
        waiting, active = self.waiting.read(batch_id), self._unfinished(self.active.read(batch_id))
        comments = self.seen.unseen(first_versions(batch.select(*COMMENT_COLUMNS)), batch_id)
        fresh = comments.join(waiting.select("comment_id"), "comment_id", "left_anti")
        due = waiting.where(F.col("next_attempt_at") <= polled_at)
        with scratch(self.spark):
            outcomes = process_comments(
                fresh.unionByName(due.select(*COMMENT_COLUMNS)),
                seen=self._none("comment_id bigint"),  # already taken out above
                jobs=self._none("comment_id bigint, status_comment_id bigint"),
                allow_list=self.allow_list,
                pull_requests=self.pull_requests,
                active=active.groupBy("queue", "requested_by").agg(F.count(F.lit(1)).alias("active")),
                failures=waiting,
                polled_at=polled_at,
            )
            self.log.write(outcomes, batch_id)
        self._advance(self.log.read_batch(batch_id), waiting, active, batch_id)
        self.writer.commit(batch_id)

    def _polled_at(self, batch: DataFrame, batch_id: int) -> datetime:
        """The time of the last poll of the batch, or now without one."""
        if "polled_at" in batch.columns:
            micros = batch.agg(F.unix_micros(F.max("polled_at"))).first()[0]
            if micros is not None:
                return datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=micros)
        return self.now(batch_id)

    def _advance(self, outcomes: DataFrame, waiting: DataFrame, active: DataFrame, batch_id: int) -> None:
        """The tables as the next batch finds them."""
        again = outcomes.where("outcome = 'retry'").withColumn("attempts", F.col("attempt"))
        left = waiting.join(outcomes.select("comment_id"), "comment_id", "left_anti")
        self.waiting.write(left.unionByName(again.select(*left.columns)), batch_id)
        queued = outcomes.where("outcome = 'queued'").withColumn("requested_by", F.col("login"))
        self.active.write(active.unionByName(queued.select(*active.columns)), batch_id)
        self.seen.write(outcomes.where("settled"), batch_id)

    def _unfinished(self, active: DataFrame) -> DataFrame:
        if self.finished is None:
            return active
        return active.join(self.finished().select("comment_id"), "comment_id", "left_anti")

    def _none(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def outcomes(self) -> DataFrame:
        return self.log.read()

    def watermark(self, current: DataFrame, polled_at) -> DataFrame:
        """The feed position of each repository, held back by unsettled comments."""
        last = F.max_by("settled", "batch").alias("settled")
        state = self.log.read().groupBy("repository", "comment_id", "updated_at").agg(last)
        return settled_watermark(state, current, polled_at)

    def run(self, landing: str, checkpoint: str, files_per_batch: int | None = None) -> None:
        """Handle the pages that have landed."""
        run_available(comment_stream(self.spark, landing, files_per_batch), self.handle, checkpoint)

    def poll(self, landing: str, polls: str, checkpoint: str, at: datetime) -> None:
        """One poll: the pages that have landed since the last one, and the attempts that are due.

        ``landing`` and ``polls`` are the same folders for every poll of a checkpoint.
        """
        land_poll(self.spark, polls, at)
        run_available(self._with_polls(landing, poll_stream(self.spark, polls)), self.handle, checkpoint)

    def watch(self, landing: str, checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
        """Poll again and again until the returned query is stopped."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        stream = self._with_polls(landing, ticks.select(F.col("timestamp").alias("polled_at")))
        return stream.writeStream.foreachBatch(self.handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

    def _with_polls(self, landing: str, polls: DataFrame) -> DataFrame:
        return comment_stream(self.spark, landing).unionByName(polls, allowMissingColumns=True)


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that has landed, then stop."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
