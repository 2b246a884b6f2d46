from conftest import SF01
from parlance.fixtures import TEST_CATALOGUE, load_lines, load_lookups
from parlance.operators.dispatch import dispatch_commands
from parlance.session import fresh_path
from parlance.streaming.dispatch import read_stream_output, stream_dispatch


def _run(spark, in_dir, out_dir, ckpt):
    q = stream_dispatch(
        spark, in_dir, out_dir, ckpt, TEST_CATALOGUE, load_lookups(spark, SF01),
        max_files_per_trigger=1,
    )
    q.awaitTermination()
    assert q.exception() is None
    return q


def test_stream_equals_batch_and_restart_adds_nothing(spark):
    in_dir, out_dir, ckpt = (fresh_path(spark, p) for p in ("s-in", "s-out", "s-ckpt"))
    lines = load_lines(spark, SF01)
    lines.repartitionByRange(3, "line_id").write.parquet(in_dir)
    q = _run(spark, in_dir, out_dir, ckpt)
    assert q.lastProgress is not None
    out = read_stream_output(spark, out_dir)
    batch = dispatch_commands(lines, TEST_CATALOGUE, load_lookups(spark, SF01))
    assert out.count() == 10_000
    assert out.exceptAll(batch).count() == 0 and batch.exceptAll(out).count() == 0
    n_batches = len({r[0] for r in spark.read.parquet(out_dir).select("batch_id").distinct().collect()})
    assert n_batches == 3

    _run(spark, in_dir, out_dir, ckpt)  # restart: nothing new
    assert read_stream_output(spark, out_dir).count() == 10_000

    extra = lines.orderBy("line_id").limit(50).selectExpr("line_id + 1000000 AS line_id", "ts", "line")
    extra.coalesce(1).write.mode("append").parquet(in_dir)
    _run(spark, in_dir, out_dir, ckpt)
    assert read_stream_output(spark, out_dir).count() == 10_050


def test_micro_batch_runs_adaptive(spark):
    """Each micro-batch is planned as a batch query with AQE on."""
    in_dir, out_dir, ckpt = (fresh_path(spark, p) for p in ("s-in", "s-out", "s-ckpt"))
    load_lines(spark, SF01).write.parquet(in_dir)
    plans = []
    from parlance.streaming import dispatch as sd

    real = sd.dispatch_commands

    def spy(*a, **k):
        df = real(*a, **k)
        plans.append(df)
        return df

    sd.dispatch_commands = spy
    try:
        _run(spark, in_dir, out_dir, ckpt)
    finally:
        sd.dispatch_commands = real
    assert plans
    assert "AdaptiveSparkPlan" in plans[0]._jdf.queryExecution().executedPlan().toString()


def test_stop_mid_run_then_restart_is_exactly_once(spark):
    import time

    in_dir, out_dir, ckpt = (fresh_path(spark, p) for p in ("s-in", "s-out", "s-ckpt"))
    lines = load_lines(spark, SF01)
    lines.repartitionByRange(5, "line_id").write.parquet(in_dir)
    look = load_lookups(spark, SF01)
    q = stream_dispatch(
        spark, in_dir, out_dir, ckpt, TEST_CATALOGUE, look,
        available_now=False, processing_time="100 milliseconds", max_files_per_trigger=1,
    )
    deadline = time.time() + 120
    while time.time() < deadline:
        done = [p for p in q.recentProgress if p["numInputRows"] > 0]
        if done:
            break
        time.sleep(0.05)
    q.stop()  # may interrupt a batch in flight
    assert q.exception() is None
    first = spark.read.parquet(out_dir).count() if _exists(out_dir) else 0
    assert first < 10_000
    _run(spark, in_dir, out_dir, ckpt)
    out = read_stream_output(spark, out_dir)
    batch = dispatch_commands(lines, TEST_CATALOGUE, look)
    assert out.count() == 10_000
    assert out.exceptAll(batch).count() == 0 and batch.exceptAll(out).count() == 0


def test_lookup_function_sees_new_files(spark):
    in_dir, out_dir, ckpt, look_dir = (fresh_path(spark, p) for p in ("s-in", "s-out", "s-ckpt", "s-look"))
    lines = load_lines(spark, SF01).filter("line LIKE 'customer %'")
    lines.write.parquet(in_dir)
    spark.createDataFrame([("customer", -1, "none")], "verb string, key bigint, body string").write.parquet(look_dir)

    def fresh_lookups():
        return spark.read.parquet(look_dir)

    q = stream_dispatch(spark, in_dir, out_dir, ckpt, TEST_CATALOGUE, fresh_lookups)
    q.awaitTermination()
    assert {r["status"] for r in read_stream_output(spark, out_dir).collect()} == {"not_found"}

    load_lookups(spark, SF01).filter("verb = 'customer'").write.mode("append").parquet(look_dir)
    lines.selectExpr("line_id + 1000000 AS line_id", "ts", "line").write.mode("append").parquet(in_dir)
    q = stream_dispatch(spark, in_dir, out_dir, ckpt, TEST_CATALOGUE, fresh_lookups)
    q.awaitTermination()
    later = read_stream_output(spark, out_dir).filter("line_id >= 1000000")
    assert {r["status"] for r in later.collect()} == {"ok"}


def _exists(path):
    import os

    from parlance.session import local_path

    return os.path.exists(local_path(path))


def test_bytes_per_trigger_bounds_batches(spark):
    import os

    from parlance.session import local_path

    in_dir, out_dir, ckpt = (fresh_path(spark, p) for p in ("b-in", "b-out", "b-ckpt"))
    load_lines(spark, SF01).repartitionByRange(4, "line_id").write.parquet(in_dir)
    sizes = [os.path.getsize(os.path.join(local_path(in_dir), f)) for f in os.listdir(local_path(in_dir)) if f.endswith(".parquet")]
    q = stream_dispatch(spark, in_dir, out_dir, ckpt, TEST_CATALOGUE, load_lookups(spark, SF01),
                        max_bytes_per_trigger=max(sizes))
    q.awaitTermination()
    batches = spark.read.parquet(out_dir).select("batch_id").distinct().count()
    assert batches >= 2
    assert read_stream_output(spark, out_dir).count() == 10_000


def test_stream_output_is_a_log_with_a_tail(spark):
    from parlance.operators.log import log_tail, read_log_tail

    in_dir, out_dir, ckpt = (fresh_path(spark, p) for p in ("t-in", "t-out", "t-ckpt"))
    lines = load_lines(spark, SF01)
    lines.repartitionByRange(3, "line_id").write.parquet(in_dir)
    _run(spark, in_dir, out_dir, ckpt)
    stored = spark.read.parquet(out_dir)
    assert {"log_date", "writer", "batch_id"} <= set(stored.columns)
    want = log_tail(dispatch_commands(lines, TEST_CATALOGUE, load_lookups(spark, SF01)), 100).collect()
    assert read_log_tail(spark, out_dir, 100).collect() == want


def test_stream_strategy_choice_and_forced_keys(spark):
    from parlance.operators.dispatch import check_lookups

    look = load_lookups(spark, SF01)
    chk = check_lookups(look)
    assert chk.fits and chk.unique and chk.rows == 1500 + 15000 + 100
    assert check_lookups(look, max_rows=10).fits is False
    assert check_lookups(look, max_rows=10).unique is None
    assert check_lookups(look, max_bytes=1000).fits is False
    in_dir, out_dir, ckpt = (fresh_path(spark, p) for p in ("k-in", "k-out", "k-ckpt"))
    lines = load_lines(spark, SF01)
    lines.repartitionByRange(3, "line_id").write.parquet(in_dir)
    q = stream_dispatch(spark, in_dir, out_dir, ckpt, TEST_CATALOGUE, look,
                        strategy="keys", max_files_per_trigger=1)
    q.awaitTermination()
    assert q.exception() is None
    out = read_stream_output(spark, out_dir)
    batch = dispatch_commands(lines, TEST_CATALOGUE, look)
    assert out.count() == 10_000
    assert out.exceptAll(batch).count() == 0 and batch.exceptAll(out).count() == 0


def test_dispatch_on_a_streaming_frame(spark):
    """Plain stream-static use of dispatch_commands (no foreachBatch)."""
    import pytest

    from parlance.streaming.dispatch import LINE_SCHEMA

    in_dir = fresh_path(spark, "sd-in")
    load_lines(spark, SF01).write.parquet(in_dir)
    stream = spark.readStream.schema(LINE_SCHEMA).parquet(in_dir)
    with pytest.raises(ValueError):
        dispatch_commands(stream, TEST_CATALOGUE, load_lookups(spark, SF01), strategy="keys")
    out = dispatch_commands(stream, TEST_CATALOGUE, load_lookups(spark, SF01))
    q = out.writeStream.format("memory").queryName("sd_out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sd_out").count() == 10_000


def test_stream_from_a_streaming_frame(spark):
    from parlance.streaming.dispatch import LINE_SCHEMA

    in_dir, out_dir, ckpt = (fresh_path(spark, p) for p in ("f2-in", "f2-out", "f2-ckpt"))
    lines = load_lines(spark, SF01)
    lines.write.parquet(in_dir)
    source = spark.readStream.schema(LINE_SCHEMA).parquet(in_dir)
    q = stream_dispatch(spark, source, out_dir, ckpt, TEST_CATALOGUE, load_lookups(spark, SF01))
    q.awaitTermination()
    out = read_stream_output(spark, out_dir)
    batch = dispatch_commands(lines, TEST_CATALOGUE, load_lookups(spark, SF01))
    assert out.exceptAll(batch).count() == 0 and batch.exceptAll(out).count() == 0


def test_stream_broadcast_bound_sends_batches_to_keys(spark):
    in_dir, out_dir, ckpt = (fresh_path(spark, p) for p in ("bb-in", "bb-out", "bb-ckpt"))
    lines = load_lines(spark, SF01)
    lines.repartitionByRange(2, "line_id").write.parquet(in_dir)
    look = load_lookups(spark, SF01)
    q = stream_dispatch(spark, in_dir, out_dir, ckpt, TEST_CATALOGUE, look,
                        max_files_per_trigger=1, broadcast_max_bytes=1000)
    q.awaitTermination()
    assert q.exception() is None
    out = read_stream_output(spark, out_dir)
    batch = dispatch_commands(lines, TEST_CATALOGUE, look)
    assert out.exceptAll(batch).count() == 0 and batch.exceptAll(out).count() == 0


def test_a_second_checkpoint_adds_to_the_log(spark):
    """Two streams with checkpoints of their own: batch ids restart, rows stay."""
    out_dir = fresh_path(spark, "two-out")
    lines = load_lines(spark, SF01)
    first, second = lines.filter("line_id % 3 = 0"), lines.filter("line_id % 3 <> 0")
    dirs = []
    for part in (first, second):
        in_dir, ckpt = fresh_path(spark, "two-in"), fresh_path(spark, "two-ckpt")
        part.write.parquet(in_dir)
        _run(spark, in_dir, out_dir, ckpt)
        dirs.append((in_dir, ckpt))
    batch = dispatch_commands(lines, TEST_CATALOGUE, load_lookups(spark, SF01))
    for in_dir, ckpt in [(None, None), *dirs]:
        if in_dir:
            _run(spark, in_dir, out_dir, ckpt)  # a restart adds nothing
        out = read_stream_output(spark, out_dir)
        assert out.exceptAll(batch).count() == 0 and batch.exceptAll(out).count() == 0
    assert spark.read.parquet(out_dir).select("writer").distinct().count() == 2


def test_output_of_a_stream_that_answered_nothing_is_empty(spark):
    out = read_stream_output(spark, fresh_path(spark, "none-out"))
    assert out.count() == 0
    assert out.columns == ["line_id", "ts", "verb", "status", "reply"]
