"""Job and stage times of one registered query, from Spark's event log.

    python scripts/stage_times.py QUERY EVENT_LOG_DIR [SF_DIR]

The query runs twice (the first run warms up); jobs of the second run are
listed with their stages (name, tasks, milliseconds). The event log is
written to EVENT_LOG_DIR (give a fresh folder); the Spark UI stays off.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _events(log_dir: str):
    for path in sorted(glob.glob(os.path.join(log_dir, "**", "events_*"), recursive=True)):
        raw = open(path, "rb").read()
        if path.endswith(".zstd"):
            import zstandard

            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode().splitlines():
            yield json.loads(line)


def report(log_dir: str, group: str) -> list[str]:
    jobs, stages = {}, {}
    for e in _events(log_dir):
        kind = e["Event"]
        if kind == "SparkListenerJobStart":
            props = e.get("Properties", {})
            jobs[e["Job ID"]] = {
                "start": e["Submission Time"],
                "group": props.get("spark.jobGroup.id"),
                "stages": e["Stage IDs"],
            }
        elif kind == "SparkListenerJobEnd" and e["Job ID"] in jobs:
            jobs[e["Job ID"]]["end"] = e["Completion Time"]
        elif kind == "SparkListenerStageCompleted":
            info = e["Stage Info"]
            stages[info["Stage ID"]] = (
                info["Stage Name"][:48],
                info["Number of Tasks"],
                info["Completion Time"] - info["Submission Time"],
            )
    out = []
    for job_id, job in sorted(jobs.items()):
        if job["group"] != group or "end" not in job:
            continue
        ran = [stages[s] for s in job["stages"] if s in stages]
        out.append(f"job {job_id}: {job['end'] - job['start']} ms {ran}")
    return out


def main() -> None:
    from parlance.registry import QUERIES
    from parlance.session import build_session

    name, log_dir = sys.argv[1], os.path.abspath(sys.argv[2])
    sf_dir = sys.argv[3] if len(sys.argv) > 3 else "/root/testdata/sf0.1"
    os.makedirs(log_dir, exist_ok=True)
    spark = build_session(
        "stage-times",
        master="local[8]",
        shuffle_partitions=8,
        extra={
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": f"file://{log_dir}",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobGroup("measured", name)
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    wall = time.perf_counter() - t0
    spark.stop()
    print(f"{name}: {wall:.3f} s wall")
    print("\n".join(report(log_dir, "measured")))


if __name__ == "__main__":
    main()
