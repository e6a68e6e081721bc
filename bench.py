"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query is forced to completion with the ``noop`` sink (full execution, no
output cost); one warm-up pass, then the median of ``$BENCH_REPEATS`` runs.
Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from featloom.plans import catalog  # noqa: E402
from featloom.session import get_session  # noqa: E402

# Model fitting/tuning are not data queries; everything else is timed.
SKIP = {"grid_sweep_rmse"}


def run_once(spark, fn, sf: str) -> float:
    t0 = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_session(f"local[{cpus}]", app="featloom-bench", shuffle_partitions=max(2 * cpus, 8),
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    names = only or [q for q in catalog.QUERIES if q not in SKIP]
    run_once(spark, catalog.QUERIES["monthly_order_features"], sf)  # warm-up: JVM, codegen caches
    times = {}
    failed = {}
    for name in names:
        try:
            runs = [run_once(spark, catalog.QUERIES[name], sf) for _ in range(repeats)]
            times[name] = round(statistics.median(runs), 3)
        except Exception as e:  # noqa: BLE001 - one broken query must not hide the others' numbers
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    sf_label = os.path.basename(sf.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_median_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf_label, "cpus": cpus, "repeats": repeats,
                      **({"failed": failed} if failed else {})}))
    spark.stop()


if __name__ == "__main__":
    main()
