"""Physical-plan summary of every registered query -> PLANS.md.

Counts shuffles (Exchange), broadcasts, Python nodes (pandas UDF /
mapInPandas), BroadcastNestedLoop joins (one-row cross joins here) and
parquet scans with the widest ReadSchema, from ``explain("formatted")``.

Usage: python tools/plan_report.py [sf_dir] [out.md]
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from winnow.plans.registry import all_queries  # noqa: E402
from winnow.session import get_spark  # noqa: E402


def plan_text(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summarize(text: str) -> dict:
    tree = text.split("\n\n")[0]
    nodes = re.findall(r"[+-]- ([A-Za-z]+)", tree) + re.findall(r"^([A-Za-z]+)", tree, re.M)
    def count(name):
        return sum(1 for n in nodes if n == name)
    schemas = re.findall(r"ReadSchema: struct<(.*)>", text)
    widest = max((len(s.split(",")) for s in schemas), default=0)
    return {
        "shuffles": count("Exchange"),
        "reused": count("ReusedExchange"),
        "broadcasts": count("BroadcastExchange"),
        "python": sum(count(n) for n in ("ArrowEvalPython", "MapInPandas", "BatchEvalPython",
                                          "MapInArrow", "FlatMapGroupsInPandas")),
        "bnlj": count("BroadcastNestedLoopJoin"),
        "smj": count("SortMergeJoin"),
        "windows": count("Window"),
        "scans": len(schemas),
        "widest_scan_cols": widest,
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out = sys.argv[2] if len(sys.argv) > 2 else "PLANS.md"
    spark = get_spark("local[8]", 16)
    rows = []
    for name, q in sorted(all_queries().items()):
        s = summarize(plan_text(q.fn(spark, sf_dir)))
        rows.append((name, s))
    cols = ["shuffles", "reused", "broadcasts", "python", "bnlj", "smj", "windows", "scans", "widest_scan_cols"]
    lines = ["# Physical plans of the registered queries", "",
             f"Generated by `tools/plan_report.py` on `{sf_dir}` (AQE initial plans, 16 shuffle partitions).",
             "`bnlj` counts nested-loop joins (none: one-row aggregates are scalar subqueries); `python` counts pandas-UDF /",
             "mapInPandas nodes; `widest_scan_cols` is the largest ReadSchema (column pruning).", "",
             "| query | " + " | ".join(cols) + " |", "|---|" + "---|" * len(cols)]
    for name, s in rows:
        lines.append(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")
    with open(out, "w") as f:
        f.write("\n".join(lines) + "\n")
    print("\n".join(lines))
    spark.stop()


if __name__ == "__main__":
    main()
