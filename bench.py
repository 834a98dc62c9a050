"""Time the headline queries; prints one JSON line.

One untimed run of the flagship query first starts the Python workers and warms the JVM. Each
query is then run once and written to Spark's no-op sink, so every output column is computed.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from redactlake.plans.queries import QUERIES

HEADLINE = [
    "badge_parse_arrow",
    "propose_badges",
    "import_inventory",
    "merge_existing",
    "alias_add",
    "pattern_set",
    "segment_markdown",
    "match_all",
    "match_all_large_inventory",
    "select_spans",
    "redact_documents",
    "redact_documents_large_inventory",
    "redact_markdown",
    "redact_conversations",
    "redact_pages",
    "restore_tagged",
    "restore_tagged_large_inventory",
    "unredact_documents",
    "roundtrip_audit",
    "build_prompts",
    "autoredact_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("redactlake-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - begin, 3)

    run("redact_documents")
    times = {name: run(name) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
