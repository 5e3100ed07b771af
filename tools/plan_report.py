"""Write PLANS.md: the shape of each registered query's final physical plan.

Usage: python tools/plan_report.py [sf_dir]
Each query runs once through the ``noop`` sink so the adaptive plan is final;
the report counts exchanges, join strategies and Python boundaries and
lists every Parquet scan with its pushed filters and read schema.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reviewlake.registry import QUERIES  # noqa: E402
from reviewlake.session import get_spark  # noqa: E402

COUNTS = {
    "shuffle": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin|Exchange SinglePartition",
    "broadcast": r"BroadcastExchange",
    "reused": r"ReusedExchange",
    "smj": r"SortMergeJoin",
    "bhj": r"BroadcastHashJoin",
    "shj": r"ShuffledHashJoin",
    "nested_loop": r"BroadcastNestedLoopJoin|CartesianProduct",
    "window": r"\bWindow\b",
    "python": r"FlatMapGroupsInPandas|MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandasWithState",
}
# one scan per line; a long filter list is cut by Spark with "..." and no closing bracket
SCAN = re.compile(r"FileScan parquet \[([^\]\n]*)\][^\n]*?PushedFilters: \[([^\]\n]*)")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark(master="local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    out = ["# PLANS", "",
           f"Final adaptive physical plans of the registered queries on `{sf_dir}` "
           "(generated by `tools/plan_report.py`).", "",
           "| query | shuffles | broadcasts | reused | SMJ | BHJ | SHJ | nested loop | window | python |",
           "| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |"]
    scans = []
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        c = {k: len(re.findall(v, plan)) for k, v in COUNTS.items()}
        out.append(f"| {name} | " + " | ".join(str(c[k]) for k in COUNTS) + " |")
        for cols, pushed in SCAN.findall(plan):
            cols = re.sub(r"#\d+L?", "", cols)
            pushed = re.sub(r"#\d+L?", "", pushed)
            scans.append(f"| {name} | {cols} | {pushed or '-'} |")
    out += ["", "Streaming queries show the batch read of their sink; their state step is "
            "`FlatMapGroupsInPandasWithState`.", "", "## Parquet scans", "",
            "| query | columns read | pushed filters |", "| --- | --- | --- |"] + scans
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out) + "\n")
    print(path)


if __name__ == "__main__":
    main()
