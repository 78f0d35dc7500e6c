"""Comment feeds and allow-lists."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lapwise.functions.names import is_login

COMMENT_DOCUMENT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("body", T.StringType()),
        T.StructField("issue_url", T.StringType()),
        T.StructField("html_url", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("user", T.StructType([T.StructField("login", T.StringType())])),
        T.StructField("repository", T.StringType()),
        T.StructField("queue", T.LongType()),
    ]
)


def comments_of(documents: DataFrame, *more: str) -> DataFrame:
    """Comments from feed documents."""
    return documents.select(
        F.col("id").alias("comment_id"), "repository", "queue", F.col("user.login").alias("login"), "issue_url",
        "body", "created_at", F.coalesce("updated_at", "created_at").alias("updated_at"), *more,
    )


def comment_stream(spark: SparkSession, landing: str, files_per_batch: int | None = None) -> DataFrame:
    """Landed feed pages as a stream of comments."""
    reader = spark.readStream.schema(COMMENT_DOCUMENT)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return comments_of(reader.json(landing))


def read_comments(spark: SparkSession, landing: str) -> DataFrame:
    """The same pages as a batch."""
    return comments_of(spark.read.schema(COMMENT_DOCUMENT).json(landing))


def comments_since(comments: DataFrame, starts: DataFrame) -> DataFrame:
    """Comments updated at or after the scan start of their repository (``repository, since``)."""
    return (
        comments.join(starts.select("repository", "since"), "repository")
        .where(F.col("updated_at") >= F.col("since"))
        .drop("since")
    )


def comment_documents(comments: DataFrame, *more: str) -> DataFrame:
    """Feed documents of comments."""
    return comments.select(
        F.col("comment_id").alias("id"), "body", "issue_url", F.lit(None).cast("string").alias("html_url"), "created_at", "updated_at",
        F.struct(F.col("login")).alias("user"), "repository", "queue", *more,
    )


def land_comments(comments: DataFrame, landing: str, pages: int | None = None) -> None:
    """Write comments as feed pages, in the order of their updates; without a number as many as their size asks for."""
    documents = comment_documents(comments)
    exact = ("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    ranged = documents.repartitionByRange("updated_at") if pages is None else documents.repartitionByRange(pages, "updated_at")
    ranged.write.mode("append").option(*exact).json(landing)


def land_poll(spark: SparkSession, polls: str, at: datetime) -> None:
    """Note that the feed is polled at a time."""
    exact = ("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    micros = (at - datetime.fromtimestamp(0, timezone.utc)) // timedelta(microseconds=1)
    spark.range(1).select(F.timestamp_micros(F.lit(micros)).alias("polled_at")).write.mode("append").option(*exact).json(polls)


def poll_stream(spark: SparkSession, polls: str) -> DataFrame:
    """The times of the polls noted."""
    return spark.readStream.schema("polled_at timestamp").json(polls)


def _checked(login: Column) -> Column:
    message = F.concat(F.lit("Not a usable login: "), login)
    return F.when(is_login(login), login).otherwise(F.raise_error(message))


def allow_list(lines: DataFrame, text: str = "value") -> DataFrame:
    """Logins, one per non-blank line, in lower case; an unusable one is an error."""
    login = F.lower(F.regexp_replace(F.col(text), r"^\s+|\s+\z", ""))
    return lines.select(login.alias("login")).where(F.col("login") != "").select(_checked(F.col("login")).alias("login")).distinct()


def read_allow_list(spark: SparkSession, path: str) -> DataFrame:
    logins = allow_list(spark.read.text(path))
    if logins.isEmpty():
        raise ValueError(f"No logins in {path}")
    return logins


def allow_list_from_text(lists: DataFrame, text: str = "value") -> DataFrame:
    """Logins of comma lists."""
    return allow_list(lists.select(F.explode(F.split(F.col(text), ",")).alias("value")))
