"""Failures during a job: retried tasks and re-run micro-batches leave
every line answered exactly once."""

import json
import os
import subprocess
import sys

import pytest

from conftest import SF01
from parlance.fixtures import TEST_CATALOGUE, load_lines, load_lookups
from parlance.session import fresh_path
from parlance.streaming.dispatch import read_stream_output, stream_dispatch


def test_task_failure_is_retried_without_duplicates():
    script = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fault_run.py")
    res = subprocess.run(
        [sys.executable, script, SF01], capture_output=True, text=True, timeout=600
    )
    assert res.returncode == 0, res.stderr[-2000:]
    out = json.loads(res.stdout.strip().splitlines()[-1])
    assert out == {"rows": 10_000, "ids": 10_000}
    assert "injected task failure" in res.stderr


def test_failed_micro_batch_is_rerun_exactly_once(spark):
    in_dir, out_dir, ckpt = (fresh_path(spark, p) for p in ("f-in", "f-out", "f-ckpt"))
    lines = load_lines(spark, SF01)
    lines.repartitionByRange(3, "line_id").write.parquet(in_dir)
    calls = {"n": 0}

    def lookups_failing_on_second_batch():
        calls["n"] += 1
        if calls["n"] == 2:
            raise RuntimeError("injected batch failure")
        return load_lookups(spark, SF01)

    q = stream_dispatch(spark, in_dir, out_dir, ckpt, TEST_CATALOGUE,
                        lookups_failing_on_second_batch, max_files_per_trigger=1)
    with pytest.raises(Exception):
        q.awaitTermination()
    assert q.exception() is not None

    q = stream_dispatch(spark, in_dir, out_dir, ckpt, TEST_CATALOGUE,
                        lambda: load_lookups(spark, SF01), max_files_per_trigger=1)
    q.awaitTermination()
    out = read_stream_output(spark, out_dir)
    assert out.count() == 10_000
    assert out.select("line_id").distinct().count() == 10_000
