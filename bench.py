"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The given tables are single files of one row group, which one core would read. Before the clock
starts they are written once more in as many files as a run has cores, as a large table would lie.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from credsieve.plans.catalog import QUERIES
from credsieve.plans.corpus import TABLES

HEADLINE = [
    "lines_documents",
    "regex_matches",
    "entropy_hits",
    "findings_custom",
    "summary",
    "diff_added_lines",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("credsieve-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    with tempfile.TemporaryDirectory(prefix="credsieve-bench-") as split:
        for name in TABLES:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(2 * int(cpus)).write.parquet(f"{split}/{name}.parquet")
        for name in HEADLINE:
            start = time.perf_counter()
            QUERIES[name](spark, split).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "scan_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
