"""Summarize the physical plan of every catalogue query.

``python -m fleetlens.plans.plan_report [sf_dir] > PLANS.md`` prints one
markdown row per query. Each row comes from ``explain("formatted")``:
scans (with pruned columns and pushed filters), exchanges, join
strategies, aggregate kinds, windows, generators and Python nodes.
Streaming queries are listed by their operators only (their plan runs
inside the stream).
"""

from __future__ import annotations

import contextlib
import io
import re
import sys

from fleetlens.plans.registry import operators, queries

STREAMING = {"health_windows", "health_windows_sliding", "health_deadlines", "attempt_sessions", "attempt_outcomes",
             "stream_dedupe", "admit_stream", "admit_live", "track_state", "track_cluster", "track_cluster_moves"}

KEEP = {"Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
        "BroadcastNestedLoopJoin", "CartesianProduct", "HashAggregate", "SortAggregate",
        "ObjectHashAggregate", "Window", "WindowGroupLimit", "Generate", "Expand", "MapInPandas",
        "TakeOrderedAndProject", "Sort"}


def explain_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def summarize(text: str) -> dict:
    lines = text.splitlines()
    counts: dict[str, int] = {}
    for ln in lines:
        m = re.match(r"^\(\d+\) (\w+)", ln)
        if m and m.group(1) in KEEP:
            counts[m.group(1)] = counts.get(m.group(1), 0) + 1
    scans = []
    for i, ln in enumerate(lines):
        if re.match(r"^\(\d+\) Scan parquet", ln):
            block = "\n".join(lines[i:i + 8])
            loc = re.search(r"Location: .*\[file:[^\]]*/([a-z]+)\.parquet\]", block)
            schema = re.search(r"ReadSchema: struct<(.*)>", block)
            pushed = re.search(r"PushedFilters: \[(.*)\]", block)
            ncols = len(re.findall(r"[a-z_]+:", schema.group(1))) if schema else 0
            scans.append((loc.group(1) if loc else "?", ncols,
                          len([p for p in (pushed.group(1).split("), ") if pushed else []) if p])))
    return {"nodes": counts, "scans": scans}


def main(argv=None) -> int:
    argv = argv if argv is not None else sys.argv[1:]
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    from fleetlens.session import get_session
    spark = get_session("local[8]", 8)
    ops = operators()
    print("| query | operator | scans (table: columns read, pushed filters) | plan nodes |")
    print("|---|---|---|---|")
    for name in sorted(queries()):
        if name in STREAMING:
            print(f"| `{name}` | {ops[name]} | stream | see `streaming/` |")
            continue
        s = summarize(explain_text(queries()[name](spark, sf_dir)))
        scans = ", ".join(f"{t}: {c} cols, {p} pushed" for t, c, p in s["scans"])
        nodes = ", ".join(f"{k} x{v}" for k, v in s["nodes"].items())
        print(f"| `{name}` | {ops[name]} | {scans} | {nodes} |")
    return 0


if __name__ == "__main__":
    sys.exit(main())
