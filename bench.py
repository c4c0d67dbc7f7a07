"""Time the headline queries; prints one JSON line.

The tables are first written again with many row groups, as a large input has them, so that scans
run on all cores.  Each query runs three times and the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

from lanternpost.plans import catalog
from lanternpost.session import local_session

HEADLINE = [
    "intent_tag_summary",
    "crisis_levels",
    "multi_tag_summary",
    "kb_chunks",
    "kb_counters",
    "hashed_vectors",
    "topk_neighbours",
    "boosted_retrieval",
    "post_retrieval",
    "reply_validity",
    "crisis_routing",
    "reply_grades",
    "threshold_sweep",
    "label_thresholds",
    "average_precision",
    "classification_report",
    "split_assignment",
    "semi_auto_tagging",
    "routed_log_counts",
    "stream_scoring",
]
TABLES = ["documents", "conversations", "embeddings", "events", "labels", "pages", "benchmark"]
RUNS = 3


def many_row_groups(spark: SparkSession, folder: str, files: int) -> str:
    """The tables that the queries read, in several files each."""
    out = tempfile.mkdtemp(prefix="bench-")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            spark.read.parquet(f"{folder}/{name}.parquet").repartition(files).write.parquet(f"{out}/{name}.parquet")
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores)
    tables = many_row_groups(spark, folder, 2 * spark.sparkContext.defaultParallelism)
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": total, "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
