"""Reports of base-versus-head jobs over several datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapwise.operators.report import multi_dataset_report, report_texts, result_message, sized_reports, trimmed_texts
from lapwise.operators.timings import pair_timings, phase_totals
from lapwise.plans.compare import Comparison
from lapwise.session import cut


def _requested(jobs: DataFrame) -> DataFrame:
    return jobs.select(F.col("id").alias("job_id"), F.posexplode("datasets").alias("dataset_pos", "dataset"))


def _lists(jobs: DataFrame) -> DataFrame:
    """The lists of datasets that jobs ask for, each once, with a row per dataset."""
    return jobs.select("datasets").distinct().select("datasets", F.posexplode("datasets").alias("dataset_pos", "dataset"))


def job_comparisons(jobs: DataFrame, comparison: Comparison) -> DataFrame:
    """Comparison text of every job, its datasets in request order.

    Each dataset's text is made once, and joined once for each list of datasets;
    no shuffle by job carries texts.
    """
    texts = trimmed_texts(report_texts(comparison.lines()))
    joined = cut(multi_dataset_report(_lists(jobs).join(texts, "dataset"), "datasets"), "comparisons")
    # Few bytes a job grow to its whole text, so jobs are dealt evenly first.
    return jobs.select(F.col("id").alias("job_id"), "datasets").repartition("job_id").join(joined, "datasets").drop("datasets")


def list_blocks(jobs: DataFrame, comparison: Comparison) -> DataFrame:
    """Blocks of every list of ``datasets`` in its order, each as far as a message can show it.

    Of a dataset's lines only those that a message can show are gathered, once;
    the lists that name it are joined to parts of bounded size.
    """
    blocks = sized_reports(comparison.lines())
    ordered = F.sort_array(F.collect_list(F.struct("dataset_pos", "blocks")))
    listed = _lists(jobs).join(blocks, "dataset").groupBy("datasets")
    return cut(listed.agg(F.flatten(F.transform(ordered, lambda e: e["blocks"])).alias("blocks")), "blocks")


def base_head_report(jobs: DataFrame, comparison: Comparison, timings: DataFrame) -> DataFrame:
    """Per job: its datasets, base and head durations, total times over the datasets.

    A dataset without compared queries counts with zero totals.
    """
    compared = (
        _requested(jobs)
        .join(comparison.totals, "dataset", "left")
        .groupBy("job_id")
        .agg(
            F.count(F.lit(1)).alias("datasets"),
            *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name) for c, name in (
                ("compared", "queries"), ("prev_time", "prev_time"), ("new_time", "new_time"),
            )],
            F.count_if(F.col("direction") == "faster").alias("faster"),
            F.count_if("highlighted").alias("highlighted"),
        )
    )
    return compared.join(phase_totals(timings), "job_id", "left").fillna(0.0, ["base_ms", "head_ms"]).fillna(
        0, ["phases"]
    )


def result_reports(
    jobs: DataFrame, comparison: Comparison, timings: DataFrame, site: str, build_target: str = "worker"
) -> DataFrame:
    """The final message of every job."""
    # One line per dataset of a request, which bounds the list.  Lists and totals come from one pass over the
    # timings, which are not shuffled here if they are dealt by job.
    lines = F.sort_array(F.collect_list(F.struct("pos", "dataset", "base_ms", "head_ms"))).alias("lines")
    phases = phase_totals(pair_timings(timings, sums=True), lines, paired=True).select(
        F.col("job_id").alias("id"), F.col("lines").alias("phases"), "base_ms", "head_ms"
    )
    blocks = list_blocks(jobs, comparison)
    # Texts come last, so that no shuffle by job carries them.
    rows = (
        jobs.join(phases, "id", "left")
        .join(blocks, "datasets", "left")
        .withColumn("blocks", F.coalesce("blocks", F.array().cast(blocks.schema["blocks"].dataType)))
        .withColumn("phases", F.coalesce("phases", F.array().cast(phases.schema["phases"].dataType)))
        .fillna(0.0, ["base_ms", "head_ms"])
    )
    return rows.select("id", result_message(site, build_target).alias("message"))
