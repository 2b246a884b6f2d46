import pytest
from pyspark.sql import functions as F

from conftest import SF01
from parlance.fixtures import TEST_CATALOGUE, load_lines, load_lookups
from parlance.operators.dispatch import dispatch_commands
from parlance.operators.log import (
    LogLayoutError,
    compact_day,
    index_batches,
    log_append,
    log_days,
    log_tail,
    log_write_batch,
    read_log,
    read_log_tail,
    tail_files,
)
from parlance.sources.declared import SchemaMismatch
from parlance.session import fresh_path


@pytest.fixture(scope="module")
def replies(spark):
    return dispatch_commands(load_lines(spark, SF01), TEST_CATALOGUE, load_lookups(spark, SF01))


def test_append_two_batches(spark, replies):
    path = fresh_path(spark, "test-log")
    first = replies.filter(F.col("status") == "ok")
    rest = replies.filter(F.col("status") != "ok")
    log_append(first, path)
    assert read_log(spark, path).count() == first.count()
    log_append(rest, path)
    back = read_log(spark, path)
    assert back.count() == 10_000
    assert back.exceptAll(replies).count() == 0 and replies.exceptAll(back).count() == 0


def test_append_checks_schema(spark, replies):
    with pytest.raises(SchemaMismatch):
        log_append(replies.drop("reply"), fresh_path(spark, "test-log"))


def _brute_tail(rows, n):
    return sorted(rows, key=lambda r: (r["ts"], r["line_id"]), reverse=True)[:n]


@pytest.mark.parametrize("n", [0, 1, 100, 9_999, 10_000, 20_000])
def test_tail_matches_brute_force(spark, replies, n):
    path = fresh_path(spark, "test-log")
    log_append(replies, path)
    want = [tuple(r) for r in _brute_tail(replies.collect(), n)]
    assert [tuple(r) for r in read_log_tail(spark, path, n).collect()] == want
    assert [tuple(r) for r in log_tail(read_log(spark, path), n).collect()] == want


def test_tail_ties_broken_by_line_id(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(i, t, "v", "ok", str(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "line_id bigint, ts timestamp_ntz, verb string, status string, reply string")
    path = fresh_path(spark, "test-log")
    log_append(df, path)
    assert [r["line_id"] for r in read_log_tail(spark, path, 3).collect()] == [9, 8, 7]


def test_tail_plan_is_top_k_over_newest_days(spark, replies):
    path = fresh_path(spark, "test-log")
    log_append(replies, path)
    df = read_log_tail(spark, path, 100)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    newest = replies.agg(F.max(F.to_date("ts"))).first()[0]
    assert {f.split("log_date=")[1][:10] for f in df.inputFiles()} == {str(newest)}


def test_tail_goes_back_from_the_newest_day_only_as_far_as_needed(spark, replies):
    path = fresh_path(spark, "test-log")
    log_append(replies, path)
    days = log_days(spark, path)
    assert days == sorted(days, reverse=True) and len(days) > 4
    per_day = {f"log_date={r[0]}": r[1] for r in replies.groupBy(F.to_date("ts")).count().collect()}

    def opened(n):
        return sorted({f.split(f"{path}/")[1].split("/")[0] for f in tail_files(spark, path, n)[0]}, reverse=True)

    assert opened(per_day[days[0]]) == days[:1]
    assert opened(per_day[days[0]] + 1) == days[:2]
    assert opened(1) == days[:1]
    assert opened(10**9) == days
    assert tail_files(spark, path, 0) == ([], None)


@pytest.fixture
def many_files(spark):
    """Settings under which a small append still writes many files."""
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def one_day(spark, rows, first=0, seed=1):
    """Replies of one day in no order, many of them at the same time."""
    line = F.col("id") + first
    return spark.range(rows).orderBy(F.rand(seed)).select(
        line.alias("line_id"),
        (F.lit("2024-03-05 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.floor(line / 7))).alias("ts"),
        F.lit("v").alias("verb"), F.lit("ok").alias("status"), line.cast("string").alias("reply"),
    )


def tail_of(rows, n):
    return sorted(rows, key=lambda r: (r["ts"], r["line_id"]), reverse=True)[:n]


def test_tail_opens_few_files_of_a_day_of_many(spark, many_files):
    path = fresh_path(spark, "test-log")
    log_append(one_day(spark, 6000), path)
    log_append(one_day(spark, 6000, first=9000, seed=2), path)  # leaves a gap, ends the day
    log_append(one_day(spark, 300, first=8900, seed=3), path, append_id="late")  # lies across both
    rows = read_log(spark, path)
    every, held = len(rows.inputFiles()), rows.collect()
    assert every > 40
    for n in (1, 7, 100, 260, 5000, 12_300, 20_000):
        df = read_log_tail(spark, path, n)
        assert df.collect() == tail_of(held, n), n
        if n <= 260:
            assert len(df.inputFiles()) <= 4, n
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in read_log_tail(spark, path, 100)._jdf.queryExecution().toString()


def test_the_scan_of_a_tail_reads_few_files_and_rows(spark, many_files):
    """Figures of the scan that ran."""
    path = fresh_path(spark, "test-log")
    log_append(one_day(spark, 6000), path)
    df = read_log_tail(spark, path, 100)
    df.collect()
    node, scan = df._jdf.queryExecution().executedPlan(), None
    leaves = node.collectLeaves()
    scan = next(leaves.apply(i) for i in range(leaves.length()) if "FileScan" in leaves.apply(i).toString())
    assert scan.metrics().apply("numFiles").value() <= 2
    assert scan.metrics().apply("numOutputRows").value() <= 600


def test_unindexed_batches_are_read_whole(spark, many_files):
    path = fresh_path(spark, "test-log")
    log_append(one_day(spark, 3000), path)
    log_write_batch(one_day(spark, 200, first=2500), path, "stream-a", 0)
    log_write_batch(one_day(spark, 500, first=10_000), path, "stream-a", 1)
    held = read_log(spark, path).collect()
    for n in (1, 100, 600, 3600, 5000):
        assert read_log_tail(spark, path, n).collect() == tail_of(held, n), n
    # a batch of the stream alone, no index at all
    path = fresh_path(spark, "test-log")
    log_write_batch(one_day(spark, 50), path, "stream-a", 0)
    assert len(read_log_tail(spark, path, 60).collect()) == 50


def test_rewritten_batch_loses_its_index_and_gets_a_new_one(spark, many_files):
    path = fresh_path(spark, "test-log")
    log_append(one_day(spark, 2000), path, append_id="load-1")
    log_append(one_day(spark, 400, first=5000), path, append_id="load-1")
    assert read_log(spark, path).count() == 400
    assert [r["line_id"] for r in read_log_tail(spark, path, 3).collect()] == [5399, 5398, 5397]
    # the same batch without an index, as after a failure before it was written
    log_write_batch(one_day(spark, 20, first=7000), path, "load-1", 0)
    assert [r["line_id"] for r in read_log_tail(spark, path, 3).collect()] == [7019, 7018, 7017]
    assert index_batches(spark, path, [f"{d}/writer=load-1/batch_id=0" for d in log_days(spark, path)]) == 1
    assert [r["line_id"] for r in read_log_tail(spark, path, 25).collect()] == list(range(7019, 6999, -1))


def test_compaction_orders_a_day_and_indexes_it(spark, many_files):
    path = fresh_path(spark, "test-log")
    for k in range(6):
        log_write_batch(one_day(spark, 700, first=700 * k, seed=k), path, "stream-a", k)
    held = read_log(spark, path).collect()
    assert compact_day(spark, path, "2024-03-05") == 5
    assert sorted(read_log(spark, path).collect()) == sorted(held)
    df = read_log_tail(spark, path, 100)
    assert df.collect() == tail_of(held, 100)
    # the stream's newest batch stays as it was written, in no order, and is opened whole
    assert sum("compact" in f for f in df.inputFiles()) <= 1
    assert sum("compact" in f for f in read_log(spark, path).inputFiles()) == 24
    assert sum("compact" in f for f in read_log_tail(spark, path, 800).inputFiles()) <= 3


@pytest.mark.parametrize("name", ["append-7", "append-compact-1", "late"])
def test_a_retried_append_replaces_itself_after_a_compaction(spark, name):
    rows = one_day(spark, 3)
    path = fresh_path(spark, "test-log")
    log_append(rows, path, append_id=name)
    log_append(one_day(spark, 2, first=50), path)
    assert read_log(spark, path).count() == 5
    compact_day(spark, path, "2024-03-05")
    log_append(rows, path, append_id=name)
    assert sorted(r["line_id"] for r in read_log(spark, path).collect()) == [0, 1, 2, 50, 51]


def test_callers_cannot_name_an_anonymous_writer(spark):
    for name in ("+append-1", "", "a/b", "a=b"):
        with pytest.raises(ValueError):
            log_append(one_day(spark, 1), fresh_path(spark, "test-log"), append_id=name or "+")


def test_log_is_partitioned_by_day(spark, replies):
    path = fresh_path(spark, "test-log")
    log_append(replies, path)
    stored = spark.read.parquet(path)
    days = stored.select("log_date").distinct().count()
    assert days == replies.select(F.to_date("ts")).distinct().count() > 1
    assert read_log(spark, path).columns == ["line_id", "ts", "verb", "status", "reply"]


def test_tail_with_null_timestamps(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, "v", "ok", "a"), (2, None, "v", "ok", "b"), (3, t + dt.timedelta(days=1), "v", "ok", "c")]
    df = spark.createDataFrame(rows, "line_id bigint, ts timestamp_ntz, verb string, status string, reply string")
    path = fresh_path(spark, "test-log")
    log_append(df, path)
    assert [r["line_id"] for r in read_log_tail(spark, path, 2).collect()] == [3, 1]
    assert [r["line_id"] for r in read_log_tail(spark, path, 3).collect()] == [3, 1, 2]
    assert [r["line_id"] for r in read_log_tail(spark, path, 5).collect()] == [3, 1, 2]


def test_rebalanced_append_writes_fewer_files(spark, replies):
    import os

    from parlance.session import local_path

    def files(path):
        return sum(
            1 for _, _, names in os.walk(local_path(path)) for n in names if n.endswith(".parquet")
        )

    spread = replies.repartition(8)  # every task holds every day
    plain, balanced = fresh_path(spark, "test-log"), fresh_path(spark, "test-log")
    log_append(spread, plain, rebalance=False)
    log_append(spread, balanced)
    assert files(balanced) < files(plain)
    a, b = read_log(spark, plain), read_log(spark, balanced)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_read_log_time_range_prunes(spark, replies):
    path = fresh_path(spark, "test-log")
    log_append(replies, path)
    since, until = "2024-01-10 06:00:00", "2024-01-12 00:00:00"
    got = read_log(spark, path, since=since, until=until)
    want = read_log(spark, path).filter(
        (F.col("ts") >= F.lit(since).cast("timestamp_ntz")) & (F.col("ts") < F.lit(until).cast("timestamp_ntz"))
    )
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan and "GreaterThanOrEqual(ts,2024-01-10T06:00)" in plan


@pytest.mark.parametrize("bad", ["yesterday", "2024-13-01", "", "2024-01-01T00:00:00+02:00"])
def test_read_log_rejects_a_malformed_bound(spark, replies, bad):
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            with pytest.raises(ValueError, match="since|until"):
                read_log(spark, fresh_path(spark, "none"), since=bad)
            with pytest.raises(ValueError, match="since|until"):
                read_log(spark, fresh_path(spark, "none"), until=bad)
        finally:
            spark.conf.set("spark.sql.ansi.enabled", "true")


def test_empty_log_reads_as_empty(spark, replies):
    path = fresh_path(spark, "test-log")
    assert read_log(spark, path).count() == 0
    assert read_log_tail(spark, path, 5).collect() == []
    assert read_log(spark, path).columns == replies.columns
    log_append(replies.limit(0), path)
    assert read_log(spark, path, since="2024-01-01").count() == 0
    assert read_log_tail(spark, path, 5).collect() == []


def test_append_with_an_id_is_idempotent(spark, replies):
    path = fresh_path(spark, "test-log")
    log_append(replies, path, append_id="load-1")
    log_append(replies, path, append_id="load-1")
    assert read_log(spark, path).count() == 10_000
    log_append(replies, path, append_id="load-2")
    assert read_log(spark, path).count() == 20_000
    with pytest.raises(ValueError):
        log_append(replies, path, append_id="a/b")


def test_both_writers_share_one_layout(spark, replies):
    path = fresh_path(spark, "test-log")
    log_append(replies, path)
    log_write_batch(replies, path, "stream-x", 0)
    log_write_batch(replies, path, "stream-y", 0)
    log_write_batch(replies, path, "stream-y", 0)
    assert read_log(spark, path).count() == 30_000


def test_another_layout_raises_before_writing(spark, replies):
    plain, by_day = fresh_path(spark, "test-log"), fresh_path(spark, "test-log")
    replies.write.parquet(plain)
    replies.withColumn("log_date", F.to_date("ts")).write.partitionBy("log_date").parquet(by_day)
    for path in (plain, by_day):
        before = spark.read.parquet(path).count()
        with pytest.raises(LogLayoutError):
            log_append(replies, path)
        with pytest.raises(LogLayoutError):
            log_write_batch(replies, path, "stream-x", 0)
        assert spark.read.parquet(path).count() == before


def _files(path):
    import os

    from parlance.session import local_path

    return sum(len([n for n in names if n.endswith(".parquet")]) for _, _, names in os.walk(local_path(path)))


def test_compaction_keeps_rows_and_the_batch_a_stream_may_run_again(spark, replies):
    path = fresh_path(spark, "test-log")
    day = replies.agg(F.max(F.to_date("ts"))).first()[0]
    rows = replies.filter(F.to_date("ts") == F.lit(day))
    for b in range(4):
        log_write_batch(rows.filter(F.col("line_id") % 4 == b), path, "stream-x", b)
    log_append(rows, path)
    want, files = rows.union(rows), _files(path)
    assert compact_day(spark, path, str(day)) == 4  # three finished batches and the append
    assert _files(path) < files
    got = read_log(spark, path)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    log_write_batch(rows.filter(F.col("line_id") % 4 == 3), path, "stream-x", 3)  # run again
    assert read_log(spark, path).count() == want.count()
    assert compact_day(spark, path, str(day)) == 0
    assert compact_day(spark, path, "1999-01-01") == 0


def test_interrupted_compaction_is_finished_later(spark, replies, monkeypatch):
    from parlance.operators import log as lg

    path = fresh_path(spark, "test-log")
    day = replies.agg(F.max(F.to_date("ts"))).first()[0]
    rows = replies.filter(F.to_date("ts") == F.lit(day))
    log_append(rows, path)
    log_append(rows, path)
    finish, calls = lg._finish_compaction, []

    def stop_second(*a):
        calls.append(a)
        if len(calls) == 2:
            raise RuntimeError("driver lost")
        return finish(*a)

    monkeypatch.setattr(lg, "_finish_compaction", stop_second)
    with pytest.raises(RuntimeError):
        compact_day(spark, path, str(day))
    monkeypatch.setattr(lg, "_finish_compaction", finish)
    assert read_log(spark, path).count() == 2 * rows.count()  # nothing replaced yet
    compact_day(spark, path, str(day))
    assert read_log(spark, path).count() == 2 * rows.count()
    assert _files(path) < 3
