"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from tracemesh.plans.queries import QUERIES
from tracemesh.session import build_session

HEADLINE = [
    "extract_entries",
    "classify_lines",
    "category_stats",
    "value_frequency",
    "frequency_report",
    "identities_greedy",
    "identities_components",
    "gap_sessions",
    "session_collect",
    "person_groups",
    "group_summary",
    "merge_log",
    "formation_graph",
    "line_cover",
    "heatmap_segments",
    "heatmap_statistics",
    "search_value",
    "tokenise",
    "hamming_partners",
    "mine_rules",
    "read_log",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")}
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/nation.parquet").groupBy("n_regionkey").count().collect()  # start-up is not part of a query
    timings = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": sf}))


if __name__ == "__main__":
    main()
