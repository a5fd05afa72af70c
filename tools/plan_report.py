"""Physical-plan summary of every registered query (no execution of the final plan).

Usage: python tools/plan_report.py [sf_dir] > PLANS.md

Counts, per query, the shuffles (hash / range / single-partition exchanges),
broadcasts, join strategies, windows, Python evaluation nodes and parquet
scans in the executed plan Spark chose (AQE initial plan).  Building some
queries runs small statistics jobs (split cut, vocabularies); those are not
part of the counted plan.
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from dwellframe.plans.registry import load_all  # noqa: E402
from dwellframe.session import local_session  # noqa: E402

PATTERNS = {
    "hash_exchange": r"Exchange hashpartitioning",
    "range_exchange": r"Exchange rangepartitioning",
    "single_partition": r"Exchange SinglePartition",
    "broadcast": r"BroadcastExchange",
    "smj": r"SortMergeJoin",
    "bhj": r"BroadcastHashJoin",
    "bnlj": r"BroadcastNestedLoopJoin",
    "window": r"\bWindow \[",
    "python": r"(BatchEvalPython|ArrowEvalPython|MapInPandas|MapInArrow|FlatMapGroupsInPandas)",
    "scans": r"FileScan parquet",
}
SKIP = {"stream_intake", "stream_scoring"}  # these run a stream to completion while being built


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    reg = load_all()
    print(f"# Physical plans ({sf.rstrip('/').split('/')[-1]}, local[8], AQE initial plans)\n")
    print("Counts of plan nodes per registered query. `single_partition` = all rows to one task "
          "(only ever on one-row or bucket-bounded inputs). Queries whose jobs run while they are built "
          "(statistics tables, splits, learners) show the plan of what is left then; their stages are in "
          "Spark's event log (`BENCH_EVENT_LOG_DIR`). `bnlj` is a join with one row of statistics, or with a branch of the stand-in quantile view, whose keys are constants.\n")
    print("| query | check | " + " | ".join(PATTERNS) + " |")
    print("|---|---|" + "---|" * len(PATTERNS))
    for name, spec in reg.items():
        if name in SKIP:
            continue
        try:
            plan = spec.build(spark, sf)._jdf.queryExecution().executedPlan().toString()
        except Exception as e:  # noqa: BLE001
            print(f"| {name} | error {type(e).__name__} |" + " |" * len(PATTERNS))
            continue
        counts = [str(len(re.findall(p, plan))) for p in PATTERNS.values()]
        print(f"| {name} | {'S' if spec.sql else 'R'} | " + " | ".join(counts) + " |")


if __name__ == "__main__":
    main(sys.argv)
