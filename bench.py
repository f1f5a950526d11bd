"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8).
Each query runs once to warm up and is then timed writing to the no-op sink, so every
row and column is produced.
"""

from __future__ import annotations

import json
import os
import time

from wardlight.plans import QUERIES
from wardlight.session import local_session

HEADLINE = [
    "scan_encounters", "drop_low_variance", "impute", "code_chapters", "first_encounter", "repeated_patients", "timeline", "cohort_union",
    "completeness", "low_variance", "missing_correlation", "distinct_counts", "outcome_pivot", "summary_by_outcome", "risk_ranking",
    "status_usage", "status_combinations", "describe_numeric", "histogram", "kde", "box_stats", "corr_pearson", "corr_spearman", "corr_kendall",
    "anova", "chi_square", "ks_two_sample", "kruskal", "mutual_info", "stratified_split", "classification_report", "roc_auc", "threshold_sweep",
    "logistic_l1", "tree_contributions", "mutual_info_knn", "label_encode", "compare_numeric", "shapiro_statistic",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores)
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total time of headline queries", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
