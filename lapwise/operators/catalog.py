"""Datasets and tables found in file listings, and plans that change them.

A listing has one row per file: ``path`` relative to its root, ``size``,
``modified_at`` and, where several roots are searched, ``root_idx``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lapwise.functions.names import TABLE_PATTERN, bucket_uri, is_dataset, schema_name

QUERY_FOLDER = "queries"
PARQUET = ".parquet"


def _part(path: str, index: int) -> Column:
    return F.get(F.split(F.col(path), "/"), F.lit(index))


def _with_parts(listing: DataFrame) -> DataFrame:
    depth = F.size(F.split(F.col("path"), "/"))
    return listing.select(
        "*",
        _part("path", 0).alias("suite"),
        _part("path", 1).alias("variant"),
        F.concat_ws("/", _part("path", 0), _part("path", 1)).alias("dataset"),
        depth.alias("depth"),
    )


def discover_datasets(listing: DataFrame) -> DataFrame:
    """Datasets beside a query folder; the earliest root that has one provides it.

    Files collapse to folders map-side, so the rest works on folders only.
    """
    folders = _with_parts(listing).where(F.col("depth") >= 2).groupBy("root_idx", "suite", "variant").agg(
        F.bool_or(F.col("depth") >= 3).alias("is_folder")
    )
    suites = folders.where(F.col("variant") == QUERY_FOLDER).select("root_idx", "suite")
    return (
        folders.where((F.col("variant") != QUERY_FOLDER) & F.col("is_folder"))
        .join(suites, ["root_idx", "suite"], "left_semi")
        .groupBy("suite", "variant")
        .agg(F.min("root_idx").alias("root_idx"))
        .select(F.concat_ws("/", "suite", "variant").alias("dataset"), "root_idx")
    )


def datasets_with_parquet(listing: DataFrame) -> DataFrame:
    """Whether a dataset holds a Parquet file at any depth."""
    return (
        _with_parts(listing)
        .where(F.col("depth") >= 3)
        .groupBy("dataset")
        .agg(F.bool_or(F.col("path").endswith(PARQUET)).alias("has_parquet"))
    )


def table_catalog(listing: DataFrame, bucket: str) -> DataFrame:
    """Tables: non-empty folders of a dataset in which every entry is a Parquet file.

    Markers that Spark itself writes (``_SUCCESS`` and checksum files) are not
    counted as entries.
    """
    entry = _part("path", 3)
    tables = (
        _with_parts(listing)
        .where((F.col("depth") >= 4) & ~entry.startswith("_") & ~entry.endswith(".crc"))
        .groupBy("suite", "dataset", _part("path", 2).alias("name"))
        .agg(F.count(F.lit(1)).alias("files"), F.bool_and(entry.endswith(PARQUET)).alias("_only_parquet"))
        .where("_only_parquet")
    )
    location = F.concat_ws("/", bucket_uri(F.lit(bucket)), "dataset", "name")
    return tables.select(
        "suite", "dataset", schema_name(F.col("dataset")).alias("schema"), "name",
        F.concat(location, F.lit("/")).alias("path"), "files",
    )


def remote_layout(listing: DataFrame, datasets: Sequence[str] | None = None) -> DataFrame:
    """Table names of the datasets in a flat object listing, with whether the name is usable."""
    keys = _with_parts(listing).where(F.col("depth") >= 4)
    if datasets is not None:
        keys = keys.where(F.col("dataset").isin(*datasets))
    tables = keys.select("dataset", _part("path", 2).alias("name")).distinct()
    return tables.select("*", F.col("name").rlike(TABLE_PATTERN).alias("valid"))


def checked_layout(spark: SparkSession, listing: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """Tables of the requested datasets; a dataset without tables or a bad table name is an error."""
    requested = spark.createDataFrame([(d,) for d in datasets], "dataset string")
    found = requested.join(remote_layout(listing, datasets), "dataset", "left")
    problem = F.when(F.col("name").isNull(), F.concat(F.lit("Dataset has no table prefixes: "), "dataset")).when(
        ~F.col("valid"), F.concat(F.lit("Invalid table name "), "name")
    )
    # A filter, so that the check stays whatever columns are read.
    return found.where(F.assert_true(problem.isNull(), problem).isNull()).select("dataset", "name")


def publish_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """What mirroring the Parquet files of a listing to a target has to do, file by file.

    New files and those whose size differs or that are newer are uploaded,
    files found only at the target are deleted.
    """
    wanted = source.where(F.col("path").endswith(PARQUET)).select(
        "path", F.col("size").alias("source_size"), F.col("modified_at").alias("source_modified")
    )
    present = target.where(F.col("path").endswith(PARQUET)).select(
        "path", F.col("size").alias("target_size"), F.col("modified_at").alias("target_modified")
    )
    changed = (F.col("source_size") != F.col("target_size")) | (F.col("source_modified") > F.col("target_modified"))
    action = (
        F.when(F.col("target_size").isNull(), "upload")
        .when(F.col("source_size").isNull(), "delete")
        .when(changed, "upload")
        .otherwise("skip")
    )
    return wanted.join(present, "path", "full_outer").select(
        "path", action.alias("action"), "source_size", "target_size"
    )


def drop_plan(listing: DataFrame, requested: DataFrame) -> DataFrame:
    """Files that deleting the requested datasets would remove.

    ``requested`` names datasets (``dataset``); an invalid name is an error.
    """
    names = distinct_requested(requested).select(
        F.when(is_dataset(F.col("dataset")), F.col("dataset"))
        .otherwise(F.raise_error(F.concat(F.lit("Invalid dataset "), "dataset")))
        .alias("dataset")
    )
    return (
        _with_parts(listing)
        .where(F.col("depth") >= 3)
        .join(names, "dataset", "left_semi")
        .select("dataset", "path", "size")
    )


def distinct_requested(requested: DataFrame, name: str = "dataset") -> DataFrame:
    """Requested names once each, with the position of their first request."""
    return requested.groupBy(name).agg(F.min("pos").alias("pos")) if "pos" in requested.columns else requested.distinct()


def select_requested(available: DataFrame, requested: DataFrame, name: str = "dataset") -> DataFrame:
    """Requested names that exist, in first-request order; everything if nothing is requested."""
    return distinct_requested(requested, name).join(available.select(name).distinct(), name, "left_semi")


def unknown_names(available: DataFrame, requested: DataFrame, name: str = "dataset") -> DataFrame:
    """Requested names that do not exist."""
    return requested.select(name).distinct().join(available.select(name).distinct(), name, "left_anti")


def split_ids(text: Column) -> Column:
    """Ids of a comma list; a list that was given but names nothing is an error, none given selects all."""
    ids = F.filter(F.transform(F.split(text, ","), lambda q: F.trim(q)), lambda q: q != "")
    empty = F.raise_error(F.lit("--queries must contain at least one query ID"))
    return F.when(text.isNotNull(), F.when(F.size(ids) == 0, empty).otherwise(ids))


def select_queries(queries: DataFrame, requests: DataFrame, keys: Sequence[str], request: str = "request") -> DataFrame:
    """Queries each request selects; a request without a list selects all queries of its dataset."""
    wanted = requests.select("*", split_ids(F.col(request)).alias("_ids"))
    listed = wanted.where(F.col("_ids").isNotNull()).select(*keys, "dataset", F.explode("_ids").alias("id")).distinct()
    everything = wanted.where(F.col("_ids").isNull()).select(*keys, "dataset")
    available = queries.select("dataset", "id").distinct()
    return listed.join(available, ["dataset", "id"], "left_semi").unionByName(
        everything.join(available, "dataset").select(*listed.columns)
    )


def duplicate_ids(entries: DataFrame, keys: Sequence[str], name: str = "id") -> DataFrame:
    """Ids listed more than once within their group."""
    return entries.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def label_collisions(worktrees: DataFrame) -> DataFrame:
    """Run labels that several branches map to.

    Branches are made distinct before they are counted, so a label used by a
    large share of all work-trees is combined map-side first.
    """
    return (
        worktrees.where(F.col("branch").isNotNull())
        .select("label", "branch")
        .distinct()
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("branches"))
        .where("branches > 1")
    )
