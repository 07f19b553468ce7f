"""Times every query and prints one JSON line.

BENCH_SF_DIR: folder of the tables; BENCH_CPUS: local cores; BENCH_RUNS: timed runs per query (best counts).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from postprism.plans.catalog import queries  # noqa: E402
from postprism.session import build_session  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = set(sys.argv[1:])
    spark = build_session(
        "postprism-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(query) -> float:
        start = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    catalog = {name: query for name, query in queries().items() if not only or name in only}
    timed(queries()["top_paying"])  # start the JVM's compilers and the readers
    seconds = {}
    for name, query in catalog.items():
        seconds[name] = round(min(timed(query) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
