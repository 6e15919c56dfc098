"""Time headline queries: BENCH_SF_DIR (default sf0.1), BENCH_CPUS cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "c2_global_index", "c3_systematic_split", "c8_stratified_split", "c10_stratified_folds",
    "e1_group_describe", "e4_e5_shape", "e8_histogram", "e10_density", "f1_shapiro_wilk_large",
    "f3_levene", "f7_welch_t", "f9_split_balance", "f10_point_biserial", "g2_correlation_pairs",
    "h1_ols", "h4_coefficients", "h5_ols_summary", "h12_leverage", "h13_pearson_residuals",
    "i2_knn_events", "i3_knn_orders", "i10_ridge", "i16_train_test_auc", "j1_auc", "j2_roc_curve_full",
    "j4_concordance", "j9_j11_cutoffs", "j10_cost_curve",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the Python workers and the code generator before the clock runs.
    run(QUERIES["f10_point_biserial"](spark, folder))
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(repeats):
            begin = time.perf_counter()
            run(QUERIES[name](spark, folder))
            took.append(time.perf_counter() - begin)
        times[name] = round(statistics.median(took), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
