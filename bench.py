"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Protocol: one warm-up run per query, then the median of the measured runs; the
total is the sum of the medians.  A result is computed completely by a no-op
sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lapwise.contract import QUERIES
from lapwise.session import local_session

HEADLINE = (
    "compare_queries", "run_totals", "pooled_q_error", "iteration_index", "parse_commands", "admission_eligible",
    "admit_requests", "settled_watermark", "fold_statements", "publish_plan", "pair_timings", "utf8_tail",
    "rewrite_date_literals", "job_state", "tpch_q1", "tpch_q3", "tpch_q5", "tpch_q6", "tpch_q7", "tpch_q8",
    "tpch_q10", "tpch_q14", "tpch_q15", "tpch_q18",
)


def run(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    iterations = int(os.environ.get("BENCH_ITERATIONS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "lapwise-bench")
    seconds = {}
    for name in HEADLINE:
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(iterations)), 4)
    print(json.dumps({
        "metric": "sum of per-query median seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "iterations": iterations, "warmup": 1,
    }))


if __name__ == "__main__":
    main()
