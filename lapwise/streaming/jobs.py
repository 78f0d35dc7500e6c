"""Streaming job state and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from lapwise.operators.jobs import job_state, latest_progress, progress_messages
from lapwise.streaming.state import BatchLog, latest_rows

JOB_EVENT = T.StructType(
    [
        T.StructField("job_id", T.LongType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("event", T.StringType()),
        T.StructField("step", T.LongType()),
    ]
)
STATE_LOG = T.StructType(
    [
        T.StructField("job_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("attempts", T.LongType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
PROGRESS_LOG = T.StructType([T.StructField("job_id", T.LongType()), T.StructField("step", T.LongType())])

# Events that carry what a progress report says, and whether it could be published.
REPORTED_EVENT = T.StructType(
    [*JOB_EVENT, T.StructField("total", T.LongType()), T.StructField("message", T.StringType()), T.StructField("published", T.BooleanType())]
)
MESSAGE_LOG = T.StructType(
    [
        T.StructField("job_id", T.LongType()),
        *REPORTED_EVENT.fields[-4:],
        T.StructField("shown_step", T.LongType()),
        T.StructField("failed_publications", T.LongType()),
        T.StructField("status", T.StringType()),
    ]
)


def job_event_stream(
    spark: SparkSession, landing: str, files_per_batch: int | None = None, schema: T.StructType = JOB_EVENT
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(landing)


def logged(folded: DataFrame, log: BatchLog, checkpoint: str) -> None:
    """Log the changed rows of a running aggregation.

    In update mode a batch writes only the jobs it changed; the aggregation
    state itself lives in the state store, partitioned by job.
    """
    query = (
        folded.writeStream.outputMode("update")
        .foreachBatch(log.write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_job_state(spark: SparkSession, events: DataFrame, state: str, checkpoint: str) -> DataFrame:
    """Fold the events that have landed; returns the current state of every job."""
    log = BatchLog(spark, f"{state}/job_state", STATE_LOG)
    logged(job_state(events), log, checkpoint)
    return latest_rows(log.read(), ["job_id"])


def run_progress(spark: SparkSession, events: DataFrame, state: str, checkpoint: str) -> DataFrame:
    """The furthest progress step of every job."""
    log = BatchLog(spark, f"{state}/progress", PROGRESS_LOG)
    logged(latest_progress(events), log, checkpoint)
    return latest_rows(log.read(), ["job_id"])


def run_progress_messages(spark: SparkSession, events: DataFrame, state: str, checkpoint: str) -> DataFrame:
    """The last message of every job, and what of its progress was published."""
    log = BatchLog(spark, f"{state}/messages", MESSAGE_LOG)
    logged(progress_messages(events), log, checkpoint)
    return latest_rows(log.read(), ["job_id"])
