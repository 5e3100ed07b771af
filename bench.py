"""Benchmark the headline jobs.

Runs each query over the whole tables of ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints ONE JSON line.
Each result is fully computed through the ``noop`` sink: nothing is
collected to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reviewlake.registry import QUERIES  # noqa: E402
from reviewlake.session import get_spark  # noqa: E402

HEADLINE = [
    "q2_review_prompts",        # flagship: runs + settings + files + feedback -> prompts
    "q1_pr_details",            # five-way fan-in
    "q3_build_requests",        # prompts -> request bodies
    "a1_a3_file_texts",         # two-level ordered file aggregation
    "a4_timeline",              # feedback timeline
    "q4_assemble_responses",    # byte-level stream reassembly (batch twin)
    "q5_review_results",        # results + latest-per-PR window
    "q7_pr_visit_feed",         # visit change detection
    "j2_anti_join_ignored",     # relational ignore filter
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(app="reviewlake-bench", master=f"local[{cpus}]", shuffle_partitions=cpus * 2,
                      extra={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    # warm-up: JIT, generated code and Python workers, on the smallest data set (no data
    # of the measured scale is read or cached here)
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in names:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus,
                      "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
