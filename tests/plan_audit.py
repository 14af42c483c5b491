"""Static plan audit of every registered query, as planned for large inputs
(adaptive execution off, no size-based broadcast): shuffles, broadcasts, scans and
Python nodes of the main plan tree (cached relations and scalar subqueries are leaves).

    python tests/plan_audit.py /root/testdata/sf0.01 > plan_audit.md
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def walk(node, out):
    if node.nodeName() == "AdaptiveSparkPlan":
        node = node.inputPlan()
    out.append(node.nodeName())
    ch = node.children()
    for i in range(ch.size()):
        walk(ch.apply(i), out)


def audit(df) -> dict[str, int]:
    names: list[str] = []
    walk(df._jdf.queryExecution().executedPlan(), names)
    count = lambda pred: sum(1 for n in names if pred(n))
    return {
        "shuffles": count(lambda n: n == "Exchange"),
        "broadcasts": count(lambda n: n == "BroadcastExchange"),
        "scans": count(lambda n: n.startswith("Scan ") or n.startswith("FileScan") or n == "InMemoryTableScan"),
        "python": count(lambda n: "Python" in n or "Pandas" in n),
        "windows": count(lambda n: n == "Window"),
        "cartesian": count(lambda n: n in ("CartesianProduct", "BroadcastNestedLoopJoin")),
    }


if __name__ == "__main__":
    from glyphframe.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    from glyphframe.plans.catalog import QUERIES

    print("| query | shuffles | broadcasts | scans | python nodes | windows | cartesian |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for name, q in sorted(QUERIES.items()):
        a = audit(q(spark, sf))
        print(f"| {name} | {a['shuffles']} | {a['broadcasts']} | {a['scans']} | {a['python']} | {a['windows']} | {a['cartesian']} |")
