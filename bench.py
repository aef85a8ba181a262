"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


def main() -> None:
    from pyspark.sql import SparkSession

    from lodespar.plans import registry

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: f for n, f in registry.queries().items() if n[0] == "q" or n.startswith(("rel_join", "rel_window", "rel_top", "rel_cube", "rel_aggregate"))}
    only = sys.argv[1:]
    times: dict[str, float] = {}
    for name, f in queries.items():
        if only and name not in only:
            continue
        best = float("inf")
        for _ in range(2):  # the first run compiles code
            start = time.perf_counter()
            f(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "total of headline queries, best of 2", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
