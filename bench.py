"""Time the headline queries and print one JSON line.

Reads the tables in $BENCH_SF_DIR on local[$BENCH_CPUS]. Every query writes all its rows to a sink
that discards them, once to warm up and then $BENCH_RUNS times; the best run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from surgeline.catalog import registered_queries  # noqa: E402
from surgeline.session import local_session  # noqa: E402

HEADLINE = [
    "daily_cumulative",
    "cumulative_snapshots",
    "derive_intervals",
    "derive_intervals_daily",
    "compute_baselines",
    "replay_baselines",
    "replay_baselines_daily",
    "percentile_nearest",
    "assess",
    "streak",
    "cycle_gates",
    "event_projection",
    "item_profile",
    "calibrate_daily",
    "legacy_scored",
    "replay_gates",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, app="surgeline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    known = registered_queries()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)
    result = {
        "metric": "total_seconds_headline_queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
        "cpus": cpus,
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
