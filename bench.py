"""Headline queries on one data folder; prints one line of JSON."""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from kindred.plans.checks import all_queries  # noqa: E402

HEADLINE = [
    "cosine_topk",
    "diverse_queries",
    "hamming_topk",
    "three_stage_search",
    "features_join_meta",
    "incremental_todo",
    "eval_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kindred-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="kindred-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans = all_queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        plans[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # The first run of each query starts Python workers and compiles its code.
    for name in HEADLINE:
        run(name)
    seconds = {name: round(min(run(name) for _ in range(3)), 3) for name in HEADLINE}
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
