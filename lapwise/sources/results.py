"""Stored results: iteration tables, result documents and run manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from lapwise.operators.ordering import natural_positions
from lapwise.session import cut

RUN_KEY = ("dataset", "engine")
QUERY_KEY = ("dataset", "engine", "id")
# Rows of one document; a longer list continues in the next part.
DOCUMENT_ROWS = 10_000
# Offending rows named in an error.
_SHOWN = 5

_ITERATION = T.StructType(
    [
        T.StructField("rowCount", T.LongType()),
        T.StructField("elapsed", T.DoubleType()),
        T.StructField("error", T.StringType()),
        T.StructField("plan", T.StringType()),
        T.StructField("tasks", T.LongType()),
        T.StructField("statsQErrorP50", T.DoubleType()),
        T.StructField("statsQErrorP95", T.DoubleType()),
    ]
)
RESULT_DOCUMENT = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("engine", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("part", T.LongType()),
        T.StructField("iterations", T.ArrayType(_ITERATION)),
    ]
)
MANIFEST_FIELDS = ("version", "startTime", "dataset", "engine", "part", "queryIds")
MANIFEST_DOCUMENT = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("startTime", T.LongType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("engine", T.StringType()),
        T.StructField("part", T.LongType()),
        T.StructField("queryIds", T.ArrayType(T.StringType())),
        T.StructField("_unknown", T.StringType()),
    ]
)


def holds(condition: Column, message: Column) -> Column:
    """A filter that every row passes, or else fails the job.

    As a filter it is kept whatever columns a reader selects; an error inside
    a column would go with the column.
    """
    return F.assert_true(F.coalesce(condition, F.lit(False)), message).isNull()


# --- iteration table ----------------------------------------------------------


def write_iterations(iterations: DataFrame, path: str, mode: str = "append") -> None:
    """Append to the iteration table, laid out by run.

    Plans go to a table of their own beside it: statistics never read them.
    """
    facts = iterations.drop("plan")
    facts.write.mode(mode).partitionBy(*RUN_KEY).parquet(f"{path}/facts")
    if "plan" in iterations.columns:
        plans = iterations.select(*QUERY_KEY, "iteration", "plan")
        plans.write.mode(mode).partitionBy(*RUN_KEY).parquet(f"{path}/plans")


def read_iterations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/facts")


def store_iterations(iterations: DataFrame, table: str, path: str | None = None, buckets: int = 200) -> None:
    """Append iterations to a catalogue table (made at ``path`` if new) that keeps the rows of a query together.

    Rows are dealt to buckets by query and sorted within them, so statistics
    per query and comparisons of stored runs need no shuffle of iterations.
    """
    facts = iterations.drop("plan")
    writer = facts.repartition(buckets, *QUERY_KEY).write.mode("append").bucketBy(buckets, *QUERY_KEY).sortBy(*QUERY_KEY)
    (writer.option("path", path) if path else writer).saveAsTable(table)


# --- result documents ---------------------------------------------------------


def result_documents(iterations: DataFrame) -> DataFrame:
    """One document per query with its iterations in order.

    A document holds a bounded number of iterations; the rest follow in
    further parts, so no list grows with the data.
    """
    fields = F.struct(
        F.col("iteration").alias("_order"),
        F.col("row_count").alias("rowCount"),
        F.col("elapsed"),
        F.col("error"),
        (F.col("plan") if "plan" in iterations.columns else F.lit("")).alias("plan"),
        F.col("tasks"),
        F.col("stats_q_error_p50").alias("statsQErrorP50"),
        F.col("stats_q_error_p95").alias("statsQErrorP95"),
    )
    part = F.floor(F.col("iteration") / DOCUMENT_ROWS).cast("bigint")
    return (
        iterations.groupBy(*QUERY_KEY, part.alias("part"))
        .agg(F.sort_array(F.collect_list(fields)).alias("iterations"))
        .withColumn("iterations", F.transform("iterations", lambda i: i.dropFields("_order")))
    )


def write_results(iterations: DataFrame, path: str) -> None:
    """Write documents as JSON, replacing those of the same queries and no others.

    Every query of a run has a folder of its own, so storing a part of a run
    leaves its other documents alone.
    """
    documents = result_documents(iterations)
    writer = documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*QUERY_KEY).json(path)


def documents_to_iterations(documents: DataFrame) -> DataFrame:
    """Explode documents into validated iterations; absent task counts become 0."""
    where = F.concat_ws("/", "dataset", "engine", "id")
    complete = F.lit(True)
    for name in ("elapsed", "rowCount", "plan"):
        complete = complete & F.col(f"i.{name}").isNotNull()
    part = F.coalesce(F.col("part"), F.lit(0))
    return (
        documents.select(*QUERY_KEY, part.alias("part"), F.posexplode_outer("iterations").alias("_pos", "i"))
        .where(F.col("_pos").isNotNull())
        .where(holds(complete, F.concat(F.lit("Invalid result, elapsed, rowCount or plan missing: "), where)))
        .select(
            *QUERY_KEY,
            (F.col("part") * DOCUMENT_ROWS + F.col("_pos")).alias("iteration"),
            F.col("i.elapsed").alias("elapsed"),
            F.col("i.rowCount").alias("row_count"),
            F.coalesce("i.tasks", F.lit(0)).cast("bigint").alias("tasks"),
            F.col("i.statsQErrorP50").alias("stats_q_error_p50"),
            F.col("i.statsQErrorP95").alias("stats_q_error_p95"),
            F.col("i.error").alias("error"),
            F.col("i.plan").alias("plan"),
        )
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Written documents; malformed JSON fails the job instead of reading as absent."""
    return spark.read.schema(RESULT_DOCUMENT).option("mode", "FAILFAST").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return documents_to_iterations(read_documents(spark, path))


def read_result_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Documents of a file-per-query store, ``.../<suite>/<variant>/<store>/<engine>/<id>.json``.

    A document that identifies another query than its file name is an error.
    """
    raw = (
        spark.read.schema(RESULT_DOCUMENT)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(paths)
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    parts = F.slice(F.split(F.url_decode(F.col("_file")), "/"), -5, 5)
    expected = F.concat(
        parts[0], F.lit("/"), parts[1], F.lit("/"), parts[3], F.lit("/"), F.regexp_replace(parts[4], r"\.json\z", "")
    )
    found = F.concat_ws("/", "dataset", "engine", "id")
    message = F.concat(F.lit("The document at "), "_file", F.lit(" is of "), found, F.lit(", its folder of "), expected)
    return documents_to_iterations(raw.where(holds(found == expected, message)).drop("_file"))


# --- manifests ----------------------------------------------------------------


def manifest_documents(entries: DataFrame) -> DataFrame:
    """Manifests from ``dataset, engine, start_time, position, id`` rows, in bounded parts."""
    part = F.floor((F.col("position") - 1) / DOCUMENT_ROWS).cast("bigint")
    listed = F.sort_array(F.collect_list(F.struct("position", "id")))
    return (
        entries.groupBy(*RUN_KEY, F.col("start_time").alias("startTime"), part.alias("part"))
        .agg(F.transform(listed, lambda e: e["id"]).alias("queryIds"))
        .select(F.lit(1).cast("bigint").alias("version"), "startTime", *RUN_KEY, "part", "queryIds")
    )


def read_manifests(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Manifest entries; unknown keys, other versions and unusable ids are errors."""
    raw = spark.read.text(path, wholetext=multi_line).withColumnRenamed("value", "_json")
    parsed = raw.select(
        "_json",
        F.from_json("_json", MANIFEST_DOCUMENT, {"mode": "FAILFAST"}).alias("m"),
        F.json_object_keys("_json").alias("_keys"),
    )
    return manifest_entries(
        parsed.select("m.version", "m.startTime", "m.dataset", "m.engine", "m.part", "m.queryIds", "_keys")
    )


def manifest_entries(documents: DataFrame) -> DataFrame:
    """Validated manifest documents, one row per listed id; an id is listed once in all parts of a manifest."""
    bad_id = F.exists(
        "queryIds", lambda q: q.isNull() | (q == "") | q.isin(".", "..") | q.contains("/")
    )
    unknown = (
        F.size(F.array_except("_keys", F.array(*[F.lit(k) for k in MANIFEST_FIELDS]))) > 0
        if "_keys" in documents.columns
        else F.lit(False)
    )
    problem = (
        F.when(unknown, "unknown keys")
        .when(~F.col("version").eqNullSafe(1), "unsupported version")
        .when(F.coalesce(F.col("startTime"), F.lit(-1)) < 0, "startTime must be a non-negative integer")
        .when(F.col("dataset").isNull() | F.col("engine").isNull() | F.col("queryIds").isNull(), "keys missing")
        .when(bad_id, "query IDs must be file names")
    )
    part = F.coalesce(F.col("part"), F.lit(0)) if "part" in documents.columns else F.lit(0)
    valid = documents.where(holds(problem.isNull(), F.concat(F.lit("Invalid manifest: "), problem)))
    entries = valid.select(
        *RUN_KEY, F.col("startTime").alias("start_time"), part.alias("_part"), F.posexplode("queryIds").alias("_pos", "id")
    ).select(
        *RUN_KEY, "start_time", (F.col("_part") * DOCUMENT_ROWS + F.col("_pos") + 1).cast("bigint").alias("position"), "id"
    )
    times = F.count(F.lit(1)).over(Window.partitionBy(*RUN_KEY, "start_time", "id"))
    repeated = F.concat(F.lit("Invalid manifest: more than one entry of "), "id")
    return entries.withColumn("_times", times).where(holds(F.col("_times") == 1, repeated)).drop("_times")


def previous_runs(runs: DataFrame) -> DataFrame:
    """The run stored last for every dataset, whenever it started."""
    last = F.max(F.struct("stored_at", "engine"))
    return runs.groupBy("dataset").agg(last.alias("last")).select("dataset", "last.engine", "last.stored_at")


def run_listing(stored: DataFrame, manifests: DataFrame) -> DataFrame:
    """What loading a run yields: its ids with their position, and whether the document is missing.

    A run with a manifest consists of exactly the listed ids, so stale
    documents are left out; a run without one is all its documents in natural
    order.  ``stored`` has one row per document (``dataset, engine, id``),
    ``manifests`` one per listed id.
    """
    present = stored.select(*QUERY_KEY).distinct()
    listed = (
        manifests.select(*QUERY_KEY, "position")
        .join(present.withColumn("_present", F.lit(True)), [*QUERY_KEY], "left")
        .select(*QUERY_KEY, "position", F.col("_present").isNull().alias("missing"))
    )
    unlisted = present.join(manifests.select(*RUN_KEY).distinct(), [*RUN_KEY], "left_anti")
    legacy = natural_positions(unlisted, RUN_KEY).withColumn("missing", F.lit(False))
    return listed.unionByName(legacy.select(*listed.columns))


def load_results(iterations: DataFrame, manifests: DataFrame) -> DataFrame:
    """Iterations of every loadable run with the position of their query; a missing document is an error."""
    return load_listed(iterations, cut(run_listing(iterations, manifests), "listing"))


def load_listed(iterations: DataFrame, listing: DataFrame) -> DataFrame:
    """Iterations of listed queries, once none of their documents is missing."""
    missing = listing.where("missing").orderBy(*QUERY_KEY).limit(_SHOWN).collect()
    if missing:
        names = ", ".join("/".join(row[k] for k in QUERY_KEY) for row in missing)
        raise ValueError(f"Of {listing.where('missing').count()} listed queries no document is stored: {names}")
    return listing.select(*QUERY_KEY, "position").join(iterations, [*QUERY_KEY])


def missing_results(stored: DataFrame, manifests: DataFrame) -> DataFrame:
    """Listed ids without a document."""
    return manifests.select(*QUERY_KEY).join(stored.select(*QUERY_KEY).distinct(), [*QUERY_KEY], "left_anti")


def load_previous(iterations: DataFrame, manifests: DataFrame) -> DataFrame:
    """Iterations of the run stored last, per dataset; datasets without a run yield nothing."""
    last = previous_runs(manifests)
    listed = manifests.join(last.select(*RUN_KEY), [*RUN_KEY], "left_semi")
    return load_results(iterations.join(last.select(*RUN_KEY), [*RUN_KEY], "left_semi"), listed)
