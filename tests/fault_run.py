"""Run in its own process: a session that retries failed tasks (local[4,4]),
with one task of the input failing on its first attempt."""

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parlance.fixtures import TEST_CATALOGUE, load_lines, load_lookups  # noqa: E402
from parlance.operators.dispatch import dispatch_commands  # noqa: E402
from parlance.operators.log import log_append, read_log  # noqa: E402
from parlance.session import build_session, fresh_path  # noqa: E402


def fail_first_attempt(batches):
    from pyspark import TaskContext

    tc = TaskContext.get()
    if tc.partitionId() == 1 and tc.attemptNumber() == 0:
        raise RuntimeError("injected task failure")
    yield from batches


def main() -> None:
    sf = sys.argv[1]
    spark = build_session("faults", master="local[4,4]", shuffle_partitions=4,
                          extra={"spark.ui.showConsoleProgress": "false"})
    lines = load_lines(spark, sf).repartition(4)
    flaky = lines.mapInPandas(fail_first_attempt, lines.schema)
    path = fresh_path(spark, "fault-log")
    log_append(dispatch_commands(flaky, TEST_CATALOGUE, load_lookups(spark, sf)), path)
    back = read_log(spark, path)
    print(json.dumps({"rows": back.count(), "ids": back.select("line_id").distinct().count()}))
    spark.stop()


if __name__ == "__main__":
    main()
