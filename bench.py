"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from surveyloom.operators.lookup import clear_scratch  # noqa: E402
from surveyloom.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "band_stats",
    "describe_numeric",
    "missing_report",
    "sample_loss",
    "corr_spearman",
    "composite_index",
    "site_left_join",
    "index_by_band",
    "percentiles_exact",
    "within_group_demean",
    "crosstab_totals",
    "chi_square",
    "model_comparison",
    "importance_regression",
    "interaction_within",
    "stratified_by_index",
    "interaction_grid",
    "segments",
    "importance_forest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # the first query of a session pays for starting it
    QUERIES["band_labels_count"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    clear_scratch(spark)
    found = re.search(r"sf([0-9.]+)$", folder.rstrip("/"))
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else folder,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
