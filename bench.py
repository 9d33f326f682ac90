"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from labelweave.plans.registry import QUERIES
from labelweave.session import local_session

HEADLINE = [
    "audit_summary",
    "split_chronological",
    "group_kfold",
    "vocab_topn",
    "tfidf_transform",
    "knn_document_f1",
    "knn_embedding",
    "macro_auc",
    "best_threshold_per_label",
    "global_threshold",
    "crossfit_metrics",
    "blend_two_way_grid",
    "blend_three_way_top10",
    "tune_knn_blend",
    "adaptive_blend",
    "label_specific_knn",
    "select_model",
    "propagate_beta_grid",
    "stack_crossfit",
    "submission_wide",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
