"""bench.py's contract with the driver: one JSON line on stdout with the agreed keys."""

from __future__ import annotations

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line(sf_small):
    env = dict(os.environ, BENCH_SF_DIR=sf_small, BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "month_filter", "area_counts"],
                         capture_output=True, text=True, env=env, timeout=600, check=True).stdout
    lines = [ln for ln in out.splitlines() if ln.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert d["metric"] == "total_query_time" and d["unit"] == "sec" and d["sf"] == 0.001
    assert set(d["queries"]) == {"month_filter", "area_counts"} and d["errors"] == {}
    assert d["value"] == round(sum(d["queries"].values()), 4)
