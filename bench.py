"""Times the headline queries at $BENCH_SF_DIR and prints one JSON line: a cold run each, then the median of two warm ones."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from quadrat.plans import catalogue

HEADLINE = (
    "tally_by_year", "tally_all_years_rollup", "tally_by_chemical_mix", "tally_by_landowner_top250", "tally_held_out", "stats_headline", "stats_by_product", "grid_interval_overlap", "grid_chemical_semijoin", "agg_county", "leaderboard_gallons",
    "candidate_pairs", "pair_scores", "components", "flags_by_cluster", "reportcard_grade", "traffic_per_day_zero_filled", "rate_limit_sliding", "site_id_decode", "dedupe_by_sha256", "radius_search", "stream_daily_views",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):
            t = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        queries[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
