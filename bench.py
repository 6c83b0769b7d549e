"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the local cores.
Every query runs to completion with its result discarded, once untimed (the first
run also writes base tables and landed files) and once timed, planning included.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from velospan.session import session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINES = [
    "activity_bins",
    "match_stations",
    "matched_trips",
    "route_join",
    "rank_pairs",
    "pair_coverage",
    "normalize_trips",
    "validate_valid",
    "day_summary",
    "running_totals",
    "station_balance",
    "balance_timeline",
    "trip_traces",
    "pack_shards",
    "plan_raw",
    "read_trip_csv",
    "export_days",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = session(
        "velospan-bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in HEADLINES:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - began, 3)
    total = round(sum(timings.values()), 3)
    scale = float(Path(folder).name.removeprefix("sf"))
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
