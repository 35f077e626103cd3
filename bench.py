"""Time the headline queries and print one JSON line.

Every query runs to a no-op sink, so all columns of all rows are computed. A
first run warms the JVM; the value per query is the median of the next three.
``BENCH_ALL=1`` takes every registered query instead of the headline ones.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from telltale.queries import QUERIES, Tables
from telltale.session import build_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = [q for q in QUERIES.values() if q.headline or os.environ.get("BENCH_ALL")]
    timings = {}
    for query in chosen:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            query.run(Tables(spark, sf_dir)).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        timings[query.name] = round(statistics.median(taken[1:] or taken), 4)
    print(
        json.dumps(
            {
                "metric": "total seconds over queries, median of repeated runs each",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": int(cpus),
                "shuffle_partitions": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
