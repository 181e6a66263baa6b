"""Summarise the final (post-AQE) physical plans of registered queries as a markdown table.

    python tools/plan_summary.py [sf_dir] [key ...]  > PLANS.md

Per query: parquet scans per table (and whether filters were pushed to
them), shuffle exchanges, broadcast exchanges, reused exchanges, join
strategies, windows, and whether any Python evaluation node appears.
"""

from __future__ import annotations

import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.plans.catalog import ENTRIES  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402
from ledgerlens.sources.binding import bound_warehouse  # noqa: E402

DEFAULT = ["tenant_month_report", "activity_counts_month", "active_base_asof", "expected_share_revenue",
           "completion_rates", "admission_mix", "conversion_age_bands", "invoice_breakdown", "seat_overview_total"]


def _final_ids(formatted: str) -> set[str]:
    """Node ids of the final (post-AQE) plan tree of a formatted explain."""
    tree = formatted.split("\n\n", 1)[0]
    if "== Final Plan ==" in tree:
        tree = tree.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    return set(re.findall(r"\((\d+)\)", tree))


def _scan_blocks(formatted: str):
    """(table, pushed filters) for every parquet scan node of the final plan."""
    ids = _final_ids(formatted)
    blocks, cur = [], None
    for line in formatted.splitlines():
        m = re.match(r"\((\d+)\) Scan parquet", line)
        if m:
            cur = {"table": "?", "pushed": ""}
            if m.group(1) in ids:
                blocks.append(cur)
        elif cur is not None and not line.strip():
            cur = None
        elif cur is not None:
            m = re.search(r"Location: [^\[]*\[[^\]]*/([a-z_]+)\]", line)
            if m:
                cur["table"] = m.group(1)
            if line.startswith("PushedFilters:"):
                cur["pushed"] = line
    return blocks


def summarise(final: str, formatted: str) -> dict:
    scans = collections.Counter()
    pushed = collections.Counter()
    for b in _scan_blocks(formatted):
        scans[b["table"]] += 1
        # a real predicate, not just the IsNotNull guards Spark adds for joins
        if re.search(r"(GreaterThan|LessThan|EqualTo|In\(|StringStartsWith|Not\()", b["pushed"]):
            pushed[b["table"]] += 1
    return {
        "scans": ", ".join(f"{t} x{n}" + (f" ({pushed[t]} pushed)" if pushed[t] else "") for t, n in sorted(scans.items())),
        "shuffles": len(re.findall(r"\bExchange hashpartitioning|ShuffleExchange|Exchange rangepartitioning|Exchange SinglePartition", final)),
        "broadcasts": final.count("BroadcastExchange"),
        "reused": final.count("ReusedExchange"),
        "bhj": final.count("BroadcastHashJoin"),
        "smj": final.count("SortMergeJoin"),
        "window": len(re.findall(r"\bWindow\b", final)),
        "python": any(x in final for x in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")),
    }


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in argv[1:] if not a.startswith("/")] or DEFAULT
    spark = local_session()
    wh = bound_warehouse(spark, sf_dir)
    print(f"Final physical plans (AQE) at `{sf_dir}`, generated by `tools/plan_summary.py`.\n")
    print("| query | parquet scans (k pushed = k of the scans got a predicate pushed into parquet) | shuffles | broadcasts | reused | BHJ | SMJ | windows | Python |")
    print("|---|---|---|---|---|---|---|---|---|")
    for key in keys:
        df = ENTRIES[key].spark_fn(wh)
        df.collect()
        qe = df._jdf.queryExecution()
        final = qe.executedPlan().toString().split("== Initial Plan ==")[0]
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        s = summarise(final, qe.explainString(mode))
        print(f"| `{key}` | {s['scans']} | {s['shuffles']} | {s['broadcasts']} | {s['reused']} | {s['bhj']} | "
              f"{s['smj']} | {s['window']} | {'yes' if s['python'] else 'no'} |")


if __name__ == "__main__":
    main(sys.argv)
