"""Print a markdown table of every registered query's physical plan at scale.

The broadcast threshold is lowered to 4 KB on sf0.1: the fixed-size
dimensions (the 25-row nation table, the 5-row region table, the literal
lookups) stay below it, while every table that grows with the scale factor is
above it even after column pruning. That reproduces the decisions the
planner's size check makes on 100 TB with its default threshold: fixed
dimensions are broadcast, everything else is shuffled (AQE may still convert
a join at run time from measured sizes). Counted from the formatted plan:

    python tests/plan_summary.py [sf_dir] > /tmp/plans.md

With `--measure` every query is also run (into the `noop` sink) with Spark's
event log written to a fresh scratch folder, and the shuffle bytes each query
writes are summed from the task-end events (attributed by job group).
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def summarize(txt: str) -> dict[str, int]:
    tree = txt.split("\n\n")[0]
    bx = tree.count("BroadcastExchange (")
    return {
        "shuffles": tree.count("Exchange (") - bx,
        "broadcasts": bx,
        "sort_merge_joins": tree.count("SortMergeJoin"),
        "hash_joins": tree.count("BroadcastHashJoin") + tree.count("ShuffledHashJoin"),
        # aggregate nodes that combine map-side (before their shuffle)
        "partial_aggs": len(re.findall(r"^Functions \[\d+\]: \[partial_", txt, re.M)),
        "top_k": tree.count("TakeOrderedAndProject") + tree.count("WindowGroupLimit"),
        "scans": tree.count("Scan parquet"),
    }


def shuffle_bytes_by_group(log_dir: str) -> dict[str, int]:
    """Sum 'Shuffle Bytes Written' of every task per job group from an event log."""
    import glob
    import json

    stage_group: dict[int, str] = {}
    task_bytes: list[tuple[int, int]] = []
    for path in sorted(glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)):
        if os.path.isdir(path) or path.endswith((".zstd", ".lz4", ".snappy", ".lzf")):
            continue
        with open(path, encoding="utf-8") as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        if group:
                            stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    m = (ev.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                    task_bytes.append((ev["Stage ID"], int(m.get("Shuffle Bytes Written", 0))))
    out: dict[str, int] = {}
    for sid, b in task_bytes:
        g = stage_group.get(sid)
        if g:
            out[g] = out.get(g, 0) + b
    return out


def main(argv) -> None:
    measure = "--measure" in argv
    args = [a for a in argv[1:] if not a.startswith("--")]
    sf_dir = args[0] if args else "/root/testdata/sf0.1"
    import tempfile

    from ridgeline.plans.catalog import QUERIES
    from ridgeline.session import build_session

    threshold = os.environ.get("PLAN_BROADCAST_BYTES", "4096")
    extra = {"spark.sql.autoBroadcastJoinThreshold": threshold}
    log_dir = None
    if measure:
        log_dir = tempfile.mkdtemp(prefix="plan-events-")
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                      "spark.eventLog.compress": "false"})
    spark = build_session(extra_conf=extra)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    cols = ["shuffles", "broadcasts", "sort_merge_joins", "hash_joins", "partial_aggs", "top_k", "scans"]
    rows = {}
    for name, fn in QUERIES.items():
        spark.sparkContext.setJobGroup(name, name)
        df = fn(spark, sf_dir)
        rows[name] = summarize(df._jdf.queryExecution().explainString(mode))
        if measure:
            df.write.format("noop").mode("overwrite").save()
    spark.stop()
    shuffled = shuffle_bytes_by_group(log_dir) if measure else {}
    head = cols + (["shuffle_KiB"] if measure else [])
    print("| query | " + " | ".join(head) + " |")
    print("| --- | " + " | ".join("---:" for _ in head) + " |")
    for name, s in rows.items():
        vals = [str(s[c]) for c in cols]
        if measure:
            vals.append(f"{shuffled.get(name, 0) / 1024:,.0f}")
        print(f"| `{name}` | " + " | ".join(vals) + " |")


if __name__ == "__main__":
    main(sys.argv)
