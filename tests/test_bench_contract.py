"""bench.py prints one JSON line with the driver's fields."""

import json
import os
import subprocess
import sys

from conftest import TESTDATA

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(
        os.environ,
        BENCH_SF_DIR=f"{TESTDATA}/sf0.001",
        BENCH_CPUS="2",
        BENCH_REPEAT="1",
        BENCH_QUERIES="q1a_idp_by_round,v4_national_dashboard,d2_idp_summary",
        BENCH_DRIVER_MEMORY="2g",
    )
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True, text=True, timeout=600
    )
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [x for x in out.stdout.splitlines() if x.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == 0.001 and d["metric"]
    assert set(d["queries"]) == {"q1a_idp_by_round", "v4_national_dashboard", "d2_idp_summary"}
    assert d["value"] == round(sum(d["queries"].values()), 3)
