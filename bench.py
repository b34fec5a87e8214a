"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from evalspark.catalog import all_queries  # noqa: E402

HEADLINE = [
    "flagship_macro_f1",
    "multilabel_macro_f1",
    "cost_report",
    "bootstrap_mean_poisson",
    "bootstrap_macro_f1",
    "score_report",
    "balanced_sample",
    "temporal_split",
    "simpleshot_predict",
    "neighbour_vote",
    "openset_full",
    "kendall_with_ties",
    "permutation_p_value",
    "zipf_exponent",
    "tail_mass",
    "leaderboard",
    "sample_clip",
    "embed_documents",
    "latest_runs",
    "backlog_reasons",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.minPartitionNum", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["micro_accuracy"](spark, folder).collect()  # start the engine
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    total = round(sum(seconds.values()), 3)
    scale = Path(folder).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
