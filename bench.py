"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is forced to completion with the ``noop`` sink (no collect to the
driver); the reported time per query is the median of $BENCH_REPEAT runs
after one warm-up run of the first query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skillweave.plans import registry  # noqa: E402
from skillweave.session import local_session  # noqa: E402

HEADLINE = ["tokens", "spans", "mappings", "requirements", "dense_matches", "triples", "validation_report",
            "full_run"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * int(cpus)), memory="12g", app="skillweave-bench")

    def once(name: str) -> float:
        registry._FLOWS.clear()
        spark.catalog.clearCache()  # each query measured on its own, nothing reused from the last
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    once(names[0])  # warm-up: JVM, code generation, Python workers
    times = {n: round(statistics.median(once(n) for _ in range(repeat)), 3) for n in names}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
