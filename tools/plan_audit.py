"""Print, per contract query, the exchanges and joins of its final plan.

usage: python tools/plan_audit.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from prefixery.plans.contract import QUERIES  # noqa: E402
from prefixery.session import build_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]", shuffle_partitions=8)
    for n in names:
        df = QUERIES[n](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        ops = re.findall(r"(BroadcastHashJoin\s+\S+\s+\S+\s+\S+|SortMergeJoin\s+\S+\s+\S+\s+\S+|"
                         r"ShuffledHashJoin\s+\S+\s+\S+\s+\S+|BroadcastNestedLoopJoin\s+\S+\s+\S+|"
                         r"CartesianProduct|Exchange \w+|BroadcastExchange|WindowGroupLimit|"
                         r"TakeOrderedAndProject|Window )", plan)
        scans = re.findall(r"(PushedFilters: \[[^\]]*\]|ReadSchema: struct<[^>]*>)", plan)
        print(f"| `{n}` | " + ", ".join(ops) + " | " + "; ".join(dict.fromkeys(scans)) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
