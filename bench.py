"""Wall time of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (cores).  Every query is planned
and run in full (``noop`` sink, all columns).  Two warm-up queries take out the
start of the session and of the Python workers.
"""

from __future__ import annotations

import json
import os
import time

from wavecohort import catalog  # noqa: F401
from wavecohort.catalog.views import QUERIES
from wavecohort.session import local_session

HEADLINE = [
    "long_form", "feature_ranges", "mean_signal", "median_signal", "recipe_fit_transform", "preset_pp1", "preset_pp2",
    "qc_funnel", "qc_within_corr", "dedup_lowest_session", "join_metadata", "stratified_group_folds_orders", "moments",
    "cv_grid", "cv_grid_lines", "cv_summary", "cv_flagship", "lda_predict", "plsda_predict", "pca_project", "mahalanobis_within",
    "patient_rollup", "vote_rollup_conf", "auc_binary", "auc_ovr", "two_level_eval", "fold_metrics", "summarize",
    "auc_bootstrap_ci", "grid_search", "random_forest",
]


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", os.environ.get("BENCH_MEMORY", "12g"))
    for name in ("class_counts", "pca_project"):
        timed(spark, name, folder)
    times = {name: timed(spark, name, folder) for name in HEADLINE}
    rows = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in ("lineitem", "orders", "events", "embeddings")}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""), "cpus": int(cpus), "rows": rows,
        "rows_per_sec": {"auc_binary": round(rows["lineitem"] / times["auc_binary"]),
                         "patient_rollup": round(rows["lineitem"] / times["patient_rollup"]),
                         "recipe_fit_transform": round(rows["embeddings"] / times["recipe_fit_transform"])},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
