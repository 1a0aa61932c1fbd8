"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the cores to use.
Every result is computed in full and written to Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from lanternrank.registry.registered import QUERIES

HEADLINE = (
    "knn_topk",
    "knn_topk_blocked",
    "knn_topk_1000",
    "text_search_topk",
    "search_report",
    "mrr_curve",
    "average_precision_labels",
    "map_in_domain",
    "map_cross_domain",
    "code_suite",
    "suite_report",
    "embed_local",
    "embed_service",
    "pool_mean",
    "pool_last",
    "collate_csn",
    "collate_code",
    "strip_c_comments",
    "strip_py_comments",
    "collapse_ws",
    "fit_tokens",
    "embedding_roundtrip",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lanternrank-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    QUERIES["knn_topk_blocked"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rsplit("sf", 1)[-1],
        "cpus": int(cpus),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
