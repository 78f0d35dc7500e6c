"""Comparisons of stored runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lapwise.operators import comparison as c
from lapwise.operators.iterations import query_summary
from lapwise.session import cut
from lapwise.sources.results import load_listed, previous_runs, run_listing


@dataclass(frozen=True)
class Comparison:
    """Tables of one comparison over any number of datasets."""

    pairs: DataFrame  # dataset, prev_engine, new_engine
    queries: DataFrame
    totals: DataFrame
    q_errors: DataFrame

    def lines(self) -> DataFrame:
        return c.comparison_lines(self.pairs, self.queries, self.totals, self.q_errors)


def compare_pairs(iterations: DataFrame, pairs: DataFrame) -> Comparison:
    """Compare the two named runs of every dataset in one job.

    Runs outside the pairs are dropped before anything is aggregated.  The
    compared queries, one row each, are written once: totals, pools and report
    lines all start from them.
    """
    # Written, their size is known: the joins below are broadcast if it is small.
    pairs = cut(pairs, "pairs")
    sides = pairs.select(
        "dataset", F.explode(F.array("prev_engine", "new_engine")).alias("engine")
    )
    used = iterations.join(sides, ["dataset", "engine"], "left_semi")
    summary = query_summary(used).join(pairs, "dataset")
    paired = c.pivot_runs(summary, F.col("prev_engine"), F.col("new_engine"))
    queries = cut(c.compare_queries(paired), "compared")
    return Comparison(pairs, queries, c.run_totals(queries), c.pooled_q_errors(used, queries))


def query_set_check(stored: DataFrame, manifests: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether both runs of every pair list the same ids in the same order."""
    return _set_check(run_listing(stored, manifests), pairs)


def _set_check(listing: DataFrame, pairs: DataFrame) -> DataFrame:
    listing = listing.join(pairs, "dataset")
    side = lambda name: listing.where(F.col("engine") == F.col(name)).select("dataset", "position", "id")
    return c.ordered_set_check(side("prev_engine"), side("new_engine"))


def compare_stored(
    iterations: DataFrame, manifests: DataFrame, pairs: DataFrame, strict: bool = True
) -> Comparison:
    """Load both runs of every pair, require equal query sets, and compare.

    With ``strict`` a pair whose sets differ or are empty fails the job;
    otherwise its dataset is left out of the result.
    """
    sides = pairs.select("dataset", F.explode(F.array("prev_engine", "new_engine")).alias("engine")).distinct()
    stored = iterations.join(sides, ["dataset", "engine"], "left_semi")
    # One row per listed query, read by the check and by loading.
    listing = cut(run_listing(stored, manifests.join(sides, ["dataset", "engine"], "left_semi")), "listing")
    checked = cut(_set_check(listing, pairs), "sets")
    if strict:
        differing = checked.where("verdict <> 'same'")
        bad = differing.orderBy("dataset").limit(5).collect()
        if bad:
            names = ", ".join(f"{row['dataset']} ({row['verdict']})" for row in bad)
            raise ValueError(f"Stored query sets differ in {differing.count()} dataset(s): {names}")
    usable = pairs.join(checked.where("verdict = 'same'"), "dataset", "left_semi")
    kept = listing.join(usable.select("dataset"), "dataset", "left_semi")
    return compare_pairs(load_listed(stored, kept).drop("position"), usable)


def previous_pairs(manifests: DataFrame, new_engine: str) -> DataFrame:
    """A new run against the run stored last, read before the new one is stored."""
    return previous_runs(manifests).select(
        "dataset", F.col("engine").alias("prev_engine"), F.lit(new_engine).alias("new_engine")
    )


def compare_with_previous(
    stored: DataFrame, manifests: DataFrame, new_iterations: DataFrame, new_engine: str
) -> Comparison:
    """Compare a run that is not stored yet with the last stored one of each dataset.

    The new run gets a name of its own while both are held together, since
    runs of one name may follow each other.
    """
    marker = "\u0000new"
    pairs = previous_pairs(manifests, marker)
    columns = ["dataset", "engine", "id", "elapsed", "tasks", "stats_q_error_p50", "stats_q_error_p95", "error"]
    last = manifests.join(
        pairs.select("dataset", F.col("prev_engine").alias("engine")), ["dataset", "engine"], "left_semi"
    )
    before = stored.join(last.select("dataset", "engine").distinct(), ["dataset", "engine"], "left_semi")
    listing = cut(run_listing(before, last), "listing")
    both = (
        load_listed(before, listing)
        .select(*columns)
        .unionByName(new_iterations.withColumn("engine", F.lit(marker)).select(*columns))
    )
    compared = compare_pairs(both, pairs)
    shown = pairs.withColumn("new_engine", F.lit(new_engine))
    names = compared.q_errors.withColumn(
        "engine", F.when(F.col("engine") == marker, F.lit(new_engine)).otherwise(F.col("engine"))
    )
    return Comparison(shown, compared.queries, compared.totals, names)
