"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is timed from building its plan to the last result row, on its second run: the first
one compiles the generated code and starts the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shelfwise import session
from shelfwise.plans.catalog import QUERIES

HEADLINE = [
    "anchor_explode",
    "visible_text",
    "extract_products",
    "upc_fallback",
    "detail_price",
    "enrich_products",
    "run_summary",
    "validation_summary",
    "quality_score",
    "dedup_products",
    "csv_roundtrip",
    "json_roundtrip",
    "jobs_latest",
    "progress_changes",
    "retry_routing",
    "attempt_outcome",
    "cache_asof",
    "cache_hits",
    "pacing_wait",
    "pacing_deny",
    "job_artifacts",
    "stream_jobs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = session(
        "shelfwise-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
