"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (tables) and BENCH_CPUS (local cores). Every query starts without cached
tables and writes its whole result to the no-op sink. A first round on the smallest tables
warms up the JVM and is not timed. Models train all their rounds and trees. Training the bundle that scoring loads
is timed on its own, as ``train_bundle``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from propensa.plans import QUERIES, modelling  # noqa: E402
from propensa.session import drop_scratch, local_session, release  # noqa: E402

HEADLINE = [
    "profile_join",
    "load_and_clean",
    "purchase_rate",
    "purchase_rate_by_segment",
    "describe_numeric",
    "correlation_matrix",
    "histogram_by_label",
    "boxplot_stats",
    "violin_density",
    "inject_missing",
    "drop_duplicates",
    "train_test_split",
    "feature_matrix",
    "minority_knn",
    "smote",
    "roc_curve",
    "roc_auc",
    "optimal_threshold",
    "threshold_report",
    "adaboost_rounds",
    "boosted_first_tree",
    "compare_models",
    "train_bundle",
    "score_new_customers",
]


def run(spark, name: str, sf_dir: str) -> float:
    release(spark)
    spark.catalog.clearCache()
    start = time.perf_counter()
    if name == "train_bundle":
        modelling.train_bundle(spark, sf_dir)
    else:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus, os.environ.get("BENCH_MEMORY", "8g"))
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_dir):
        for name in only:
            run(spark, name, warm_dir)
    times = {name: round(run(spark, name, sf_dir), 3) for name in only}
    drop_scratch(spark)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
