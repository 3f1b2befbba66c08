"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8). Each query is
planned and run into a ``noop`` sink; the time includes planning. The second run counts, so
that class loading is not part of it; ``cold`` holds the first.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from codelode.operators.retrieve import parts, prefilter, token_index, write_token_index
from codelode.queries.registry import QUERIES, bench_tasks, doc_units

NAMES = [
    "prefilter_topk", "rank_files", "code_units", "tables_mined", "hit_rate", "stem_vocab",
    "split_tasks", "minified_files", "code_callers", "commit_targets", "scored_scan",
    "scan_questions",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def one_task(spark, sf_dir):
    """One task on a stored index, which is written before the clock starts."""
    task = bench_tasks(spark, sf_dir).where("task_id = '0'")
    return prefilter(parts(task, "none"), spark.table("bench_stems"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("codelode.read.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = {"token_index": lambda s, d: token_index(doc_units(s, d))}
    todo |= {name: QUERIES[name] for name in NAMES}
    spark.sql("drop table if exists bench_stems")
    write_token_index(doc_units(spark, sf_dir), "bench_stems", int(cpus))
    todo["one_task"] = one_task
    warm, cold = {}, {}
    for name, query in todo.items():
        for times in (cold, warm):
            start = time.perf_counter()
            run(query(spark, sf_dir))
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_warm_seconds", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": int(cpus), "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
