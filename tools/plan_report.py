"""Physical-plan census of every registered query (markdown to stdout).

For each query: Spark jobs run while the plan was built (statistics probes,
numbering, model fits), and in the final physical plan the number of hash /
range shuffles, broadcasts, window operators with their partition keys,
Python stages and Parquet scans.  Usage: python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, ".")

from gridlake.config import build_session  # noqa: E402
from gridlake.plans.catalog import REGISTRY  # noqa: E402


def census(plan: str) -> dict:
    lines = plan.splitlines()
    windows = []
    for ln in lines:
        m = re.search(r"Window \[.*?\], \[(.*?)\], \[", ln)
        if m:
            keys = re.sub(r"#\d+L?", "", m.group(1))
            windows.append(keys or "-")
    return {
        "shuffle": sum(1 for ln in lines if re.search(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", ln)),
        "broadcast": sum(1 for ln in lines if "BroadcastExchange" in ln),
        "python": sum(1 for ln in lines if re.search(r"FlatMapGroupsInPandas|MapInPandas|ArrowEvalPython|FlatMapGroupsInPandasWithState", ln)),
        "scans": sum(1 for ln in lines if "FileScan" in ln or "Scan parquet" in ln or "Scan ExistingRDD" in ln
                     or "LocalTableScan" in ln),
        "windows": sorted(set(windows)),
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    st = spark.sparkContext.statusTracker()
    print("| query | build jobs | shuffles | broadcasts | python stages | window partition keys |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name, q in REGISTRY.items():
        before = len(st.getJobIdsForGroup())
        df = q.spark(spark, sf)
        jobs = len(st.getJobIdsForGroup()) - before
        plan = df._jdf.queryExecution().executedPlan().toString()
        c = census(plan)
        print(f"| {name} | {jobs} | {c['shuffle']} | {c['broadcast']} | {c['python']} | "
              f"{'; '.join(c['windows']) or '-'} |")


if __name__ == "__main__":
    main()
