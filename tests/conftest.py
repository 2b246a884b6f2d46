import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from parlance.session import build_session

    s = build_session(
        "parlance-tests",
        master=os.environ.get("PARLANCE_TEST_MASTER", "local[*]"),
        shuffle_partitions=8,
        extra={"spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024)},
    )
    if not s.sparkContext.getCheckpointDir() and not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parlance-test-ckpt-"))
    yield s
    s.stop()


def lines_df(spark, rows):
    """(line_id, ts, line) rows from a list of line strings."""
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    data = [(i, base + dt.timedelta(seconds=i), line) for i, line in enumerate(rows)]
    return spark.createDataFrame(data, "line_id bigint, ts timestamp_ntz, line string")
