"""Times every query at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs twice, all its rows going to the no-op sink; the second run counts, so that the
compilation of plans is left out.
"""

from __future__ import annotations

import json
import os
import time

from coinbrook.checks.queries import registered
from coinbrook.session import local_session


def seconds(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    spark = local_session(
        cores, "bench", **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")}
    )
    times = {}
    for name, query in registered().items():
        seconds(spark, query, sf_dir)
        times[name] = round(seconds(spark, query, sf_dir), 3)
    spark.stop()
    result = {
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "cpus": int(cores),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
