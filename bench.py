"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from tessera import catalog

HEADLINE = [
    "fanout_where_select", "target_multi_shard_dedup", "demux_by_shard", "merge_ordered_asc", "merge_ordered_desc", "ordered_top_k",
    "terminal_count", "hash_string_key", "hash_fnv1a64", "route_hash_mod", "route_consistent", "route_with_existing_map",
    "ring_add_shard_churn", "map_upsert", "topology_counts", "topology_fingerprint", "plan_moves_ordered", "plan_dry_run",
    "verify_checksum", "migrate_swap", "health_state_fold", "sharded_join_agg", "sharded_window_rank",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):  # the first run warms up
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(median(runs[1:]), 4)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
