"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores.
Each query is run twice into a no-op sink; the better run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from workload import all_queries  # noqa: E402

HEADLINE = (
    "clip_and_fill_by_type", "parquet_scan", "infer_kinds", "text_step", "rule_chain", "drop_duplicates",
    "dedup_subset_first", "filter_chain", "numeric_profile_lineitem", "distinct_counts", "entropy",
    "common_values", "null_patterns", "iqr_bounds_lineitem", "winsorize", "remove_outlier_rows", "impute_automatic",
    "impute_mode", "fill_forward", "fill_backward_by_hot_key", "interpolate", "histogram_lineitem",
    "density_comparison", "correlation_matrix", "top_values_with_others", "changed_rows_view", "full_profile",
    "prepare_run", "treat_run", "step_list_run", "full_run",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    if names == ["all"]:
        names = list(queries)
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
        print(f"{name}: first {runs[0]:.2f}s, best {times[name]:.2f}s", file=sys.stderr)
    scale = Path(folder).name.removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
