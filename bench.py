"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_RUNS the
warm runs of which the median counts. Every result is written in full to a sink
that discards it, so no work can be skipped.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from creditloom.plans import QUERIES
from creditloom.session import local_session

HEADLINE = [
    "customer_features",
    "installment_history",
    "pos_history",
    "card_history",
    "bureau_history",
    "previous_history",
    "application_clean",
    "one_hot_columns",
    "baseline_aligned",
    "missing_values",
    "money_description",
    "feature_correlation_matrix",
    "train_test_split",
    "applicant_histories",
    "pending_applicants",
    "decision_statistics",
    "home_dashboard",
    "top_factors",
    "narrations",
    "waterfall_steps",
    "global_importance",
    "roc_curve",
    "roc_area",
    "f1_by_threshold",
    "calibration_bins",
    "every_fifth_row",
    "decision_statistics_stream",
    "delinquency_warning_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, "bench", shuffle_partitions=int(cpus))
    seconds = {}
    for name in HEADLINE:
        build = QUERIES[name].build
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, median of warm runs, summed",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
