"""Writers that change stored datasets and reports."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from lapwise.operators.catalog import drop_plan, publish_plan
from lapwise.operators.comparison import line_order
from lapwise.session import cut, folder_exists, hadoop_path, remove_folder
from lapwise.sources.commits import CommitConflict, Commits


def write_report(lines: DataFrame, path: str) -> None:
    """Comparison lines in report order as one text per dataset folder.

    Ranges are cut between lines, so the files of a dataset, in the order of
    their names, hold its text however many lines it has.
    """
    (
        lines.repartitionByRange(*line_order())
        .sortWithinPartitions(*line_order())
        .select("dataset", F.col("line").alias("value"))
        .write.mode("overwrite")
        .partitionBy("dataset")
        .text(path)
    )


_LISTING = "path string, size bigint, modified_at timestamp"


def table_files(spark: SparkSession, tables: Mapping[str, str]) -> DataFrame:
    """Parquet files of tables by ``<table>/<file>``, with size and time; only their metadata is read."""
    listing = spark.createDataFrame([], _LISTING)
    for name, path in tables.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        last = F.element_at(F.split("path", "/"), -1)
        listing = listing.unionByName(
            files.load(path).select(
                F.concat(F.lit(f"{name}/"), last).alias("path"),
                F.col("length").alias("size"),
                F.col("modificationTime").alias("modified_at"),
            )
        )
    return listing


def publish_dataset(spark: SparkSession, tables: Mapping[str, str], target: str) -> dict[str, str]:
    """Mirror the tables of a dataset at a target; returns what was done with each: upload, skip or delete.

    The files a target was made from are recorded beside it.  The plan compares
    them with the tables' files now: tables with new, changed or vanished files
    are written anew, tables found only at the target are deleted, and the rest
    is left alone.  Success markers are left out: a folder counts as a table
    only if it holds nothing but Parquet files.
    """
    if not tables:
        raise ValueError("Dataset contains no Parquet files")
    target = target.rstrip("/")
    record = f"{target}.published"
    known = spark.read.schema(_LISTING).parquet(record) if folder_exists(spark, record) else spark.createDataFrame([], _LISTING)
    source = table_files(spark, tables)
    actions = _table_actions(source, known)
    for name, action in actions.items():
        if action == "upload":
            _write_table(spark, tables[name], f"{target}/{name}")
        elif action == "delete":
            remove_folder(spark, f"{target}/{name}")
    source.write.mode("overwrite").parquet(record)
    return actions


def _table_actions(source: DataFrame, known: DataFrame) -> dict[str, str]:
    """Upload, skip or delete for every table of two file listings."""
    plan = publish_plan(source, known).withColumn("name", F.substring_index("path", "/", 1))
    # One row per table.
    changes = plan.groupBy("name").agg(F.count_if(F.col("action") != "skip").alias("changed"), F.count("source_size").alias("files"))
    return {r["name"]: "delete" if not r["files"] else "upload" if r["changed"] else "skip" for r in sorted(changes.collect())}


def _write_table(spark: SparkSession, source: str, path: str) -> None:
    """A copy of a table without success markers."""
    option = ("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    spark.read.parquet(source).write.mode("overwrite").option(*option).parquet(path)


def publish_version(spark: SparkSession, tables: Mapping[str, str], target: str) -> dict[str, str]:
    """Publish the tables of a dataset as its next version; returns what was done with each, as :func:`publish_dataset` does.

    Changed tables are written to folders of their own, unchanged ones stay
    where an earlier version has them, and one commit names the folders of all.
    Readers (:func:`published_tables`) see the version before until then and
    afterwards this one.  A writer that another has overtaken fails and removes
    what it wrote; after a crash the next version is made from the last one.
    """
    if not tables:
        raise ValueError("Dataset contains no Parquet files")
    target = target.rstrip("/")
    commits = Commits(spark, f"{target}/commits")
    number, last = commits.latest() or (-1, {"tables": {}, "listing": None})
    known = spark.read.schema(_LISTING).parquet(f"{target}/{last['listing']}") if last["listing"] else spark.createDataFrame([], _LISTING)
    source = cut(table_files(spark, tables), "listing")
    actions = _table_actions(source, known)
    own = f"versions/{uuid.uuid4().hex}"
    folders = {}
    for name, action in actions.items():
        if action == "upload":
            folders[name] = f"{own}/tables/{name}"
            _write_table(spark, tables[name], f"{target}/{folders[name]}")
        elif action == "skip":
            folders[name] = last["tables"][name]
    source.write.parquet(f"{target}/{own}/listing")
    try:
        commits.commit(number + 1, {"tables": folders, "listing": f"{own}/listing"})
    except CommitConflict:
        remove_folder(spark, f"{target}/{own}")
        raise
    return actions


def published_tables(spark: SparkSession, target: str, version: int | None = None) -> dict[str, str]:
    """Paths of the tables of a published version, the last one unless another is asked for."""
    commits = Commits(spark, f"{target.rstrip('/')}/commits")
    if version is None:
        last = commits.latest()
        version = last[0] if last else 0
    record = commits.read(version)
    if record is None:
        raise ValueError(f"No version {version} is published at {target}")
    return {name: f"{target.rstrip('/')}/{folder}" for name, folder in record["tables"].items()}


def remove_old_versions(spark: SparkSession, target: str, keep: int = 2) -> None:
    """Forget all but the last versions, and remove the folders that those kept do not name.

    Not for times when a writer is at work: its folders are named by no version yet.
    """
    target = target.rstrip("/")
    commits = Commits(spark, f"{target}/commits")
    numbers = commits.numbers()[-keep:]
    records = [commits.read(n) for n in numbers]
    used = {f for r in records for f in (*r["tables"].values(), r["listing"])}
    versions, store = hadoop_path(spark, f"{target}/versions")
    if numbers:
        commits.forget(numbers[0])
    for version in store.listStatus(versions) if folder_exists(spark, f"{target}/versions") else ():
        name = version.getPath().getName()
        if not any(folder.startswith(f"versions/{name}/") for folder in used):
            remove_folder(spark, f"{target}/versions/{name}")


def confirmed_drop_plan(spark: SparkSession, listing: DataFrame, datasets: Sequence[str], confirm: bool) -> DataFrame:
    """The deletion plan of the named datasets, only with explicit confirmation."""
    if not confirm:
        raise ValueError("Confirm the permanent deletion of datasets")
    if not datasets:
        raise ValueError("Select at least one dataset")
    requested = spark.createDataFrame(list(enumerate(datasets)), "pos bigint, dataset string")
    return drop_plan(listing, requested)
