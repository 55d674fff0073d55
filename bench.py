"""Headline queries: prints one JSON line with seconds per query.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Each query runs once to
warm up and once measured; results go to a sink that computes every column.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES

HEADLINE = (
    "decisions_by_source",
    "scan_spans",
    "policy_messages",
    "normalize_noisy",
    "nfkc",
    "clean_html",
    "clean_email",
    "create_documents",
    "chunks",
    "chunk_rollup",
    "screened_documents",
    "blocked_documents",
    "sanitized_texts",
    "safe_contexts",
    "prepared_rows",
    "document_frequency",
    "tfidf_weights",
    "metrics_by_lang",
    "threshold_sweep",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
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

    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in names:
        run(name)
        seconds[name] = run(name)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total warm seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
