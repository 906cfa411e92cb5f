"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores.  Every query is run in full into a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tracelake.registry import QUERIES
from tracelake.session import build_session, drop_scratch

HEADLINE = (
    "history_retrieval_topk",
    "dense_position",
    "history_window20",
    "chunk_fixed",
    "attention_state",
    "distance_time",
    "stage1_topk",
    "greedy_select",
    "jaccard_item_neighbors",
    "edge_merge",
    "new_concept_split",
    "binary_metrics",
    "rasch_difficulty",
    "ctfidf_labels",
    "three_line_round_trip",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        drop_scratch(spark)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
