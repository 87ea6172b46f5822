"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from isotherm.plans import catalogue
from isotherm.plans.registry import run
from isotherm.session import local_session

HEADLINE = (
    "merge_tiers", "daily_metrics", "yearly_bands", "records", "rank_value", "doy_bands", "circular_median", "history_theta",
    "weekly_gap", "year_shuffle_test", "forecast_tier", "tail_labels", "bilinear_lookup", "error_summary", "per_cell_scores",
    "conformal_shift", "rung_coverage", "nearest_cell", "zonal_population", "unique_names", "sessionize", "hits_over_time",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalogue.load()
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    run("extents", spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(name, spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
