"""Options of a run as Spark settings."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession, functions as F


@dataclass(frozen=True)
class Setting:
    option: str
    spark_name: str | None
    fit: str  # direct, near, static, always_on or unsupported


# Run options in their fixed order, with the Spark setting closest to each.
SETTINGS = (
    Setting("file_scan_config_bytes_per_partition", "spark.sql.files.maxPartitionBytes", "direct"),
    Setting("cardinality_task_count_factor", None, "unsupported"),
    Setting("batch_size", "spark.sql.parquet.columnarReaderBatchSize", "direct"),
    Setting("shuffle_batch_size", None, "unsupported"),
    Setting("collect_metrics", None, "always_on"),
    Setting("compression", "spark.io.compression.codec", "static"),
    Setting("children_isolator_unions", None, "unsupported"),
    Setting("broadcast_joins", "spark.sql.autoBroadcastJoinThreshold", "direct"),
    Setting("partial_reduce", None, "unsupported"),
    Setting("dynamic_task_count", "spark.sql.adaptive.enabled", "near"),
    Setting("dynamic_bytes_per_partition", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "direct"),
    Setting("max_tasks_per_stage", "spark.sql.shuffle.partitions", "near"),
    Setting("repartition_file_min_size", "spark.sql.files.openCostInBytes", "near"),
    Setting("target_partitions", "spark.sql.shuffle.partitions", "near"),
)
_DEFAULT_BROADCAST_BYTES = "10485760"


def setting_statements(options: Mapping[str, Column]) -> Column:
    """``SET name=value;`` lines of the options that are given; false and 0 are kept."""
    unknown = set(options) - {s.option for s in SETTINGS}
    if unknown:
        raise ValueError(f"Unknown option(s): {', '.join(sorted(unknown))}")
    lines = [
        F.when(
            options[s.option].isNotNull(),
            F.concat(F.lit(f"SET {s.option}="), options[s.option].cast("string"), F.lit(";")),
        )
        for s in SETTINGS
        if s.option in options
    ]
    return F.concat_ws("\n", *lines)


def apply_settings(spark: SparkSession, options: Mapping[str, object]) -> dict[str, str]:
    """Apply the given options to the session and report what became of each.

    Options that Spark cannot follow at run time are reported, never dropped
    silently.
    """
    unknown = set(options) - {s.option for s in SETTINGS}
    if unknown:
        raise ValueError(f"Unknown option(s): {', '.join(sorted(unknown))}")
    report = {}
    for setting in SETTINGS:
        value = options.get(setting.option)
        if value is None:
            continue
        if setting.fit in ("unsupported", "always_on", "static"):
            report[setting.option] = setting.fit
            continue
        if setting.option == "broadcast_joins":
            text = _DEFAULT_BROADCAST_BYTES if value else "-1"
        else:
            text = str(value).lower() if isinstance(value, bool) else str(value)
        if setting.spark_name == "spark.sql.shuffle.partitions" and text == "0":
            report[setting.option] = "default"  # 0 means no limit
            continue
        spark.conf.set(setting.spark_name, text)
        report[setting.option] = f"{setting.spark_name}={text}"
    return report


@contextmanager
def applied_settings(spark: SparkSession, options: Mapping[str, object]) -> Iterator[dict[str, str]]:
    """Settings that hold for the jobs run inside; the session's own values come back afterwards.

    Plans are fixed when they run, so a result must be executed inside.
    """
    names = {s.spark_name for s in SETTINGS if s.spark_name and s.fit in ("direct", "near")}
    before = {name: spark.conf.get(name) for name in names}
    try:
        yield apply_settings(spark, options)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
