"""Table scans: plain, as views, and with registered types."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_type

from lapwise.session import cut

from lapwise.sources.registry import REGISTRY, Registry, spark_type

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

CONFORMANCE_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType(), False),
        T.StructField("column_name", T.StringType(), False),
        T.StructField("column_type", T.StringType(), False),
    ]
)


def table_path(directory: str, name: str) -> str:
    return f"{directory.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(directory, name))


def register_tables(spark: SparkSession, paths: Mapping[str, str]) -> list[str]:
    """Make every table queryable by name, replacing earlier views of that name."""
    for name, path in paths.items():
        spark.read.parquet(path.replace("s3://", "s3a://", 1)).createOrReplaceTempView(name)
    return list(paths)


def typed(df: DataFrame, suite: str, table: str, registry: Registry = REGISTRY) -> DataFrame:
    """The registered columns with their registered types.

    As with an external table, columns absent from the files read as null and
    unregistered ones are not visible.  The casts sit on the scan, so column
    pruning still reaches the files.
    """
    actual = set(df.columns)
    columns = []
    for name, registered in registry.columns(suite, table):
        source = F.col(name) if name in actual else F.lit(None)
        columns.append(source.cast(spark_type(registered)).alias(name))
    return df.select(*columns)


def scan_typed(spark: SparkSession, path: str, suite: str, table: str, registry: Registry = REGISTRY) -> DataFrame:
    return typed(spark.read.parquet(path), suite, table, registry)


def schema_conformance(
    spark: SparkSession, suite: str, tables: Mapping[str, DataFrame], registry: Registry = REGISTRY
) -> DataFrame:
    """Actual against registered columns, with the values that would not survive the cast.

    ``outcome`` is ``match``, ``type_differs``, ``missing`` (registered only)
    or ``extra`` (present only).  Schemas are metadata; the value counts come
    from one aggregation per table.
    """
    registered_rows, actual_rows, counts = [], [], []
    for table in registry.tables(suite):
        for name, kind in registry.columns(suite, table):
            registered_rows.append((table, name, spark_type(kind).simpleString()))
    for table, df in tables.items():
        actual_rows += [(table, field.name, field.dataType.simpleString()) for field in df.schema]
        counts.append(_value_counts(df, suite, table, registry))
    registered = spark.createDataFrame(registered_rows, CONFORMANCE_SCHEMA).withColumnRenamed(
        "column_type", "registered_type"
    )
    actual = spark.createDataFrame(actual_rows, CONFORMANCE_SCHEMA).withColumnRenamed("column_type", "actual_type")
    values = counts[0]
    for more in counts[1:]:
        values = values.unionByName(more)
    key = ["table_name", "column_name"]
    outcome = (
        F.when(F.col("actual_type").isNull(), "missing")
        .when(F.col("registered_type").isNull(), "extra")
        .when(F.col("actual_type") == F.col("registered_type"), "match")
        .otherwise("type_differs")
    )
    return (
        registered.join(actual, key, "full_outer")
        .join(values, key, "left")
        .select(*key, "registered_type", "actual_type", outcome.alias("outcome"), "value_count", "lossy_count")
    )


def _value_counts(df: DataFrame, suite: str, table: str, registry: Registry) -> DataFrame:
    """One row per column: non-null values, and those that become null in the registered type."""
    kinds = dict(registry.columns(suite, table)) if table in registry.tables(suite) else {}
    measures = []
    for name in df.columns:
        column = F.col(name)
        lost = column.isNotNull() & column.try_cast(spark_type(kinds[name])).isNull() if name in kinds else F.lit(False)
        measures.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count(column).alias("value_count"),
                F.count_if(lost).alias("lossy_count"),
            )
        )
    return (
        df.agg(F.array(*measures).alias("columns"))
        .select(F.lit(table).alias("table_name"), F.inline("columns"))
    )


_FOOTER = "table_name string, file string, column_name string, file_type string"


def file_columns(files: DataFrame) -> DataFrame:
    """Columns and types of Parquet files (``table_name``, ``path``) from their footers alone, read by the tasks."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for table, path in zip(*(batch.column(c).to_pylist() for c in ("table_name", "path"))):
                store, inner = pafs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as file:
                    schema = pq.read_schema(file)
                rows += [(table, path, f.name, from_arrow_type(f.type).simpleString()) for f in schema]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["table_name", "file", "column_name", "file_type"])

    return files.select("table_name", "path").mapInArrow(footers, _FOOTER)


def parquet_files(spark: SparkSession, tables: Mapping[str, str]) -> DataFrame:
    """``table_name`` and ``path`` of the Parquet files of tables; only the listing is read."""
    listing = spark.createDataFrame([], "table_name string, path string")
    for name, path in tables.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        listing = listing.unionByName(files.load(path).select(F.lit(name).alias("table_name"), F.url_decode("path").alias("path")))
    # A footer costs a round trip to the store, so a task takes a few files only.
    return listing.repartition("path")


def differing_files(spark: SparkSession, tables: Mapping[str, str]) -> DataFrame:
    """Files whose columns are not those that most files of their table have.

    ``outcome`` is ``type_differs``, ``missing`` or ``extra``.  Spark infers the
    schema of a table from one file, so a scan shows none of these.
    """
    columns = cut(file_columns(parquet_files(spark, tables)), "footers")
    counts = columns.groupBy("table_name", "column_name", "file_type").agg(F.count(F.lit(1)).alias("files"))
    usual = counts.groupBy("table_name", "column_name").agg(
        F.sum("files").alias("having"), F.min(F.struct((-F.col("files")).alias("n"), "file_type"))["file_type"].alias("usual_type")
    )
    sizes = columns.select("table_name", "file").distinct().groupBy("table_name").agg(F.count(F.lit(1)).alias("all_files"))
    expected = usual.join(sizes, "table_name").select("table_name", "column_name", "usual_type", (2 * F.col("having") > F.col("all_files")).alias("expected"))
    key = ["table_name", "column_name"]
    wanted = columns.select("table_name", "file").distinct().join(expected.where("expected"), "table_name")
    missing = wanted.join(columns, ["table_name", "file", "column_name"], "left_anti").select(
        "table_name", "file", "column_name", F.lit(None).cast("string").alias("file_type"), "usual_type", F.lit("missing").alias("outcome")
    )
    outcome = F.when(~F.col("expected"), "extra").when(F.col("file_type") != F.col("usual_type"), "type_differs")
    present = columns.join(expected, key).withColumn("outcome", outcome).where("outcome IS NOT NULL").select(*missing.columns)
    return present.unionByName(missing)
