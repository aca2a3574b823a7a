"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names,
comma separated), BENCH_RUNS (default 1; the best run counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

from flowtide.catalog import QUERIES
from flowtide.session import local_session

HEADLINE = [
    "filter_combined",
    "in_network_list",
    "lines_extended",
    "flows_csv_form",
    "aggregate_five_tuple",
    "aggregate_bidirectional",
    "aggregate_by_subnet",
    "stat_ip_shares",
    "top_flows_six_orders",
    "summary",
    "port_histogram",
    "entropy_source",
    "entropy_six_keys",
    "unique_counts",
    "kl_divergence_six_keys",
    "renyi_divergence_six_keys",
    "kl_entropy_product",
    "handshake_counts",
    "syn_flood",
    "ddos_test",
    "flooding_level",
    "stock_market",
    "centroid_distance_tcp",
    "late_flows",
    "channel_timeseries",
    "anonymised_flows",
    "sequence_gaps",
    "metric_run_with_dependencies",
    "row_to_centre_distances",
    "feature_center_columns_median",
    "stream_slot_counters",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="flowtide-bench")
    # start the JVM's code paths before the clock does
    QUERIES["flows_per_hour"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
            spark.catalog.clearCache()
        seconds[name] = round(best, 3)
        print(f"{name}: {best:.2f} s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
