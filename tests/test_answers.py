import pytest
from pyspark.sql import functions as F

from conftest import SF01, lines_df
from parlance.fixtures import TEST_CATALOGUE, load_lines, load_lookups
from parlance.operators.answers import VERSION, AnswerTable, lookup_version
from parlance.operators.dispatch import Catalogue, dispatch_commands
from parlance.session import fresh_path
from parlance.streaming.dispatch import read_appended, read_stream_output, stream_append, stream_dispatch

LOOKUP = "verb string, key bigint, body string"


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture
def builds(monkeypatch):
    """Versions of answers written, in order."""
    seen, real = [], AnswerTable._build

    def build(self, lookups, version):
        seen.append(version)
        return real(self, lookups, version)

    monkeypatch.setattr(AnswerTable, "_build", build)
    return seen


def stored(spark, rows, path=None, mode="append"):
    path = path or fresh_path(spark, "lookups")
    spark.createDataFrame(rows, LOOKUP).coalesce(1).write.mode(mode).parquet(path)
    return path


# ---------------------------------------------------------------- versions
def test_version_follows_files_and_query(spark):
    path = stored(spark, [("a", 1, "x")])
    read = lambda: spark.read.parquet(path)
    one = lookup_version(read())
    assert one and lookup_version(read()) == one
    assert lookup_version(read().withColumn("body", F.upper("body"))) != one
    assert lookup_version(read().where("key > 0")) != lookup_version(read().where("key > 1"))
    both = read().union(spark.read.parquet(stored(spark, [("b", 1, "y")])))
    assert lookup_version(both) not in (None, one)
    old = read()
    stored(spark, [("a", 2, "z")], path)
    assert lookup_version(read()) != one
    assert lookup_version(old) == one  # its listing was made before
    stored(spark, [("a", 1, "x")], path, "overwrite")
    assert lookup_version(read()) != one  # rewritten, if alike


def test_no_version_without_files(spark):
    assert lookup_version(spark.createDataFrame([("a", 1, "x")], LOOKUP)) is None
    mixed = spark.read.parquet(stored(spark, [("a", 1, "x")])).union(spark.createDataFrame([("b", 1, "x")], LOOKUP))
    assert lookup_version(mixed) is None
    assert lookup_version(spark.range(3).selectExpr("'a' verb", "id key", "'x' body")) is None


def test_table_is_written_once_a_version(spark, builds):
    path, where = stored(spark, [("a", 1, "x"), ("a", 1, "w"), ("a", 2, None)]), fresh_path(spark, "answers")
    table = AnswerTable(spark, where)
    first = table.current(spark.read.parquet(path))
    assert sorted(map(tuple, first.frame.collect())) == [("a", 1, 2, "w"), ("a", 2, 1, None)]
    assert first.rows == 2 and first.fits() and not first.fits(max_rows=1) and not first.fits(max_bytes=10)
    assert table.current(spark.read.parquet(path)) is first
    # another start finds it
    again = AnswerTable(spark, where).current(spark.read.parquet(path))
    assert again.version == first.version and again.rows == 2 and len(builds) == 1
    for k in range(3):
        stored(spark, [("b", k, "y")], path)
        assert table.current(spark.read.parquet(path)).rows == 3 + k
    assert len(builds) == 4
    left = [f.split(VERSION)[1] for f in _names(spark, where) if VERSION in f]
    assert sorted(left) == sorted(builds[-2:])  # the newest and the one before it


def _names(spark, path):
    import os

    from parlance.session import local_path

    return [n for n in os.listdir(local_path(path)) if not n.startswith(".")]


def test_a_version_left_half_written_is_written_again(spark, builds):
    import os

    from parlance.session import local_path

    path, where = stored(spark, [("a", 1, "x")]), fresh_path(spark, "answers")
    version = AnswerTable(spark, where).current(spark.read.parquet(path)).version
    os.remove(f"{local_path(where)}/{VERSION}{version}/_SUCCESS")
    assert AnswerTable(spark, where).current(spark.read.parquet(path)).rows == 1
    assert builds == [version, version]


# ---------------------------------------------------------------- dispatch
@pytest.mark.parametrize("strategy", ["auto", "shuffle", "keys"])
def test_answers_give_the_same_replies(spark, strategy):
    lines, look = load_lines(spark, SF01), load_lookups(spark, SF01)
    answers = AnswerTable(spark, fresh_path(spark, "answers")).current(look)
    got = dispatch_commands(lines, TEST_CATALOGUE, answers, strategy=strategy)
    assert same(got, dispatch_commands(lines, TEST_CATALOGUE, look))
    hot = dispatch_commands(lines, TEST_CATALOGUE, answers, strategy=strategy, hot_key_lines=3)
    assert same(hot, got)


def test_answers_are_joined_without_an_aggregation(spark):
    lines = load_lines(spark, SF01)
    answers = AnswerTable(spark, fresh_path(spark, "answers")).current(load_lookups(spark, SF01))
    plan = dispatch_commands(lines, TEST_CATALOGUE, answers)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2


CAT = Catalogue([("a", 1)])


def repeated(spark, kind):
    rows = spark.createDataFrame([("a", 1, "y"), ("a", 1, "x"), ("a", 2, "z")], LOOKUP)
    return AnswerTable(spark, fresh_path(spark, "answers")).current(rows) if kind == "answers" else rows


@pytest.mark.parametrize("kind", ["lookups", "answers"])
@pytest.mark.parametrize("col", ["status", "reply", "*"])
def test_a_repeated_key_fails_whatever_is_read(spark, kind, col):
    look = repeated(spark, kind)
    for options in ({}, {"strategy": "shuffle"}, {"strategy": "keys"}, {"hot_key_lines": 1}):
        out = dispatch_commands(lines_df(spark, ["a 1", "a 2"]), CAT, look, **options)
        with pytest.raises(Exception, match="keys must be unique"):
            out.select(col).collect()
        fine = dispatch_commands(lines_df(spark, ["a 2", "a 3", "b"]), CAT, look, **options)
        assert [r[0] for r in fine.orderBy("line_id").select("status").collect()] == ["ok", "not_found", "unknown_command"]
        loose = dispatch_commands(lines_df(spark, ["a 1"]), CAT, look, check_unique=False, **options)
        assert loose.select("status", "reply").collect() == [("ok", "x")]


# ---------------------------------------------------------------- streams
def test_lookups_are_aggregated_once_in_a_run_of_many_batches(spark, builds):
    in_dir, out_dir, ckpt = (fresh_path(spark, p) for p in ("a-in", "a-out", "a-ckpt"))
    lines = load_lines(spark, SF01)
    lines.repartitionByRange(6, "line_id").write.parquet(in_dir)
    for _ in range(2):  # a restart too
        q = stream_dispatch(
            spark, in_dir, out_dir, ckpt, TEST_CATALOGUE, lambda: load_lookups(spark, SF01), max_files_per_trigger=1
        )
        q.awaitTermination()
        assert q.exception() is None
    assert len(builds) == 1
    assert spark.read.parquet(out_dir).select("batch_id").distinct().count() == 6
    assert same(read_stream_output(spark, out_dir), dispatch_commands(lines, TEST_CATALOGUE, load_lookups(spark, SF01)))


def test_changed_lookups_are_seen_while_the_stream_runs(spark, builds):
    in_dir, out_dir, ckpt = (fresh_path(spark, p) for p in ("c-in", "c-out", "c-ckpt"))
    path = stored(spark, [("a", 1, "old")])
    calls = []

    def lookups():
        calls.append(1)
        if len(calls) == 3:
            stored(spark, [("a", 2, "new")], path)
        return spark.read.parquet(path)

    lines_df(spark, [f"a {1 + k % 2}" for k in range(8)]).repartitionByRange(4, "line_id").write.parquet(in_dir)
    q = stream_dispatch(spark, in_dir, out_dir, ckpt, CAT, lookups, max_files_per_trigger=1)
    q.awaitTermination()
    assert q.exception() is None and len(calls) == 4 and len(builds) == 2
    rows = spark.read.parquet(out_dir).orderBy("line_id").collect()
    assert {r["reply"] for r in rows if r["line_id"] % 2 == 0} == {"old"}
    late = [(r["batch_id"], r["reply"]) for r in rows if r["line_id"] % 2]
    assert all(reply == ("new" if batch >= 2 else "not_found") for batch, reply in late) and len(late) == 4


def test_file_sink_equals_batch_and_restart_adds_nothing(spark, builds):
    in_dir, out_dir, ckpt = (fresh_path(spark, p) for p in ("n-in", "n-out", "n-ckpt"))
    lines, look = load_lines(spark, SF01), load_lookups(spark, SF01)
    assert read_appended(spark, out_dir).count() == 0
    lines.repartitionByRange(3, "line_id").write.parquet(in_dir)
    counts = {}

    def run():
        q = stream_append(spark, in_dir, out_dir, ckpt, TEST_CATALOGUE, look, max_files_per_trigger=1)
        q.awaitTermination()
        assert q.exception() is None
        for p in q.recentProgress:
            told = p.observedMetrics.get("statuses")
            for k, v in (told.asDict() if told else {}).items():
                counts[k] = counts.get(k, 0) + v

    run()
    want = dispatch_commands(lines, TEST_CATALOGUE, look)
    assert same(read_appended(spark, out_dir), want)
    per = {r[0]: r[1] for r in want.groupBy("status").count().collect()}
    assert {k: v for k, v in counts.items() if v} == {**per, "lines": 10_000}
    run()
    assert read_appended(spark, out_dir).count() == 10_000 and len(builds) == 1
    lines.where("line_id < 50").selectExpr("line_id + 1000000 AS line_id", "ts", "line").coalesce(1).write.mode("append").parquet(in_dir)
    run()
    assert read_appended(spark, out_dir).count() == 10_000 + lines.where("line_id < 50").count()


def test_file_sink_fails_on_a_repeated_key_and_leaves_no_row(spark):
    in_dir, out_dir, ckpt = (fresh_path(spark, p) for p in ("r-in", "r-out", "r-ckpt"))
    lines_df(spark, ["a 2", "a 1"]).coalesce(1).write.parquet(in_dir)
    q = stream_append(spark, in_dir, out_dir, ckpt, CAT, repeated(spark, "lookups"))
    with pytest.raises(Exception, match="keys must be unique"):
        q.awaitTermination()
    assert read_appended(spark, out_dir).count() == 0


# ---------------------------------------------------------------- counts
def test_statuses_are_counted_in_the_same_pass(spark):
    from pyspark.sql import Observation

    from parlance.operators.dispatch import STATUSES, observe_statuses

    replies = dispatch_commands(load_lines(spark, SF01), TEST_CATALOGUE, load_lookups(spark, SF01))
    tracker = spark.sparkContext.statusTracker()

    def jobs(df, group):
        spark.sparkContext.setJobGroup(group, group)
        try:
            df.write.format("noop").mode("overwrite").save()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    seen = Observation()
    assert jobs(observe_statuses(replies, seen), "observed") == jobs(replies, "plain")
    want = {r[0]: r[1] for r in replies.groupBy("status").count().collect()}
    assert seen.get == {**dict.fromkeys(STATUSES, 0), **want, "lines": 10_000}
