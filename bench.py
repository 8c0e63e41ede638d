"""Times the headline queries on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "scan_parquet", "sql_group_sum", "clean_mean", "clean_median", "clean_mode", "clean_full", "transform_scale",
    "transform_clip", "profile_missing", "profile_describe", "profile_value_counts", "profile_columns", "dist_histogram",
    "dist_kde", "dist_boxplot", "corr_matrix", "pair_bins", "top_categories", "fact_measure_by_dim", "fact_group_share",
    "fact_rows_by_year", "extract_json", "extract_lines", "forecast_sma", "forecast_frequency", "series_diff",
    "forecast_arima", "new_files_antijoin", "customer_segments",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tablewright.plans.catalog import QUERIES

    # One untimed query starts the executor threads and loads classes.
    QUERIES["sql_group_sum"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    sf = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
