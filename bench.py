"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from regiometric import spark_session
from workloads.queries import REGISTRY

HEADLINES = [
    "region_mart", "share_by_class", "headcount_distinct", "jobs_per_person", "wide_types", "bed_sums_in_list",
    "training_supply", "gdp_by_region", "mean_distance_override", "class_share_zero_fill", "rank_first", "top10_ties",
    "group_median_strict", "six_number", "box_stats_of_lines", "state_box", "rates_wide", "state_medians_vs_density",
    "corr_test", "corr_matrix", "multi_ols", "fitted_line", "map_layer", "colour_bucket",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = spark_session(
        "bench", f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_driver_memory="8g",
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["group_mean"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up is not timed
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(json.dumps({
        "metric": "headline queries, total time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
