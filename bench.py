"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the input folder, ``BENCH_CPUS`` the number of local cores.
Each query runs to a sink that discards the rows, so all columns are computed.

The driver's tables are single files of one row group, which one task reads whatever the
number of cores. They are copied once, outside the timing, into several files of small row
groups, as tables of any size come; ``BENCH_TILES=0`` times the tables as they are.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from filingloom.plans import catalog  # noqa: E402
from filingloom.session import TABLES, build_session  # noqa: E402

HEADLINE = (
    "html_to_text",
    "section_spans",
    "chunk_windows",
    "example_build",
    "dataset_stats",
    "company_holdout_split",
    "newest_n_per_company",
    "download_manifest",
    "validate_examples",
    "token_f1_documents",
    "rouge_l_documents",
    "numeric_match",
    "metrics_by_task_dispatch",
    "aggregate_metrics",
    "compare_by_task",
    "prediction_join",
    "latency_percentiles",
    "sliding_rate_limit",
    "fixed_window_limit",
    "secret_scan",
)


def tiled(spark, sf_dir: str, files: int) -> str:
    """A copy of the tables in ``files`` files each."""
    folder = tempfile.mkdtemp(prefix="bench-tables-")
    for name in TABLES:
        table = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
        table.repartition(files).write.option("parquet.block.size", str(1 << 20)).parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session(
        "filingloom-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    tiles = os.environ.get("BENCH_TILES", "1") != "0"
    tables = tiled(spark, sf_dir, 2 * int(cpus)) if tiles else sf_dir
    times: dict[str, float] = {}
    for key in only or HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[key](spark, tables).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "tiled": tiles,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
