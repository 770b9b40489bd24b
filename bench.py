"""Time the headline queries and print one JSON line.

Tables come from $BENCH_SF_DIR, cores from $BENCH_CPUS. Every query is built
and run to the end into a sink that keeps nothing: once to warm up, then twice; the better time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

HEADLINE = (
    "agg1_usage_statistics",
    "agg2_document_analytics",
    "agg3_user_analytics",
    "agg4_daily_performance",
    "agg5_popular_document_types",
    "agg6_simplification_effectiveness",
    "agg7_storage_statistics",
    "agg8_processing_by_file_type",
    "agg10_user_uploads",
    "jn1_results_with_metadata",
    "jn6_results_with_processing_time",
    "srt1_latest_documents_per_user",
    "snk5_update_metadata",
    "snk6_delete_documents",
    "fn1_normalised_text",
    "fn4_complexity",
    "job6_corpus_complexity",
    "rsp5_structured_responses",
    "fn22_markdown_report",
    "job2_simplified_documents",
    "agg12_batch_summary",
    "job4_answers",
    "str2_streamed_daily_metrics",
)


def run(query, spark, sf_dir) -> float:
    start = time.perf_counter()
    query.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def _scale(sf_dir: str) -> float | str:
    """The scale factor a folder is named after, or the name itself."""
    name = Path(sf_dir).name.removeprefix("sf")
    try:
        return float(name)
    except ValueError:
        return name


def main() -> None:
    from clauselight.catalog import load

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call sites are recorded per expression otherwise, one round trip each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()
    seconds = {}
    for name in HEADLINE:
        run(queries[name], spark, sf_dir)
        seconds[name] = round(min(run(queries[name], spark, sf_dir) for _ in range(2)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": _scale(sf_dir),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
