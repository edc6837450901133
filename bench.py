"""Times every query twice and keeps the lower time; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_QUERIES (optional) a
comma-separated choice of queries. Results go to the no-op sink, so all rows are
computed and none reaches the driver.
"""

from __future__ import annotations

import json
import os
import time

from textbench.catalog.queries import QUERIES
from textbench.session import build_session, clear_work


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else list(QUERIES)
    spark = build_session("bench", cpus)

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("accuracy")  # start the JVM's compilers before timing
    seconds = {name: min(run(name), run(name)) for name in names}
    result = {
        "metric": "total_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }
    if "train_classifier" in seconds:
        from textbench.fixtures import trainable
        from textbench.plans.training import Settings

        rows = trainable(spark, sf_dir).filter("split = 'train'").count()
        passes = Settings().passes[-1]
        result["train_rows_per_sec"] = round(rows * passes / seconds["train_classifier"], 1)
    clear_work(spark)
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
