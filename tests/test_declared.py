import os
import warnings

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from parlance.sources.declared import SchemaMismatch, declared_scan, schema_problems, as_struct
from parlance.sources.tables import TABLE_SCHEMAS, read_table, table_path

NATION = "n_nationkey int, n_name string, n_regionkey int"


def _jobs(spark, fn, group):
    sc = spark.sparkContext
    sc.setJobGroup(group, "schema check")
    try:
        fn()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return list(sc.statusTracker().getJobIdsForGroup(group))


def test_exact_schema(spark):
    df = declared_scan(spark, table_path(SF001, "nation"), NATION)
    assert df.count() == 25
    assert df.schema == as_struct(NATION)


def test_int_widens_to_bigint(spark):
    df = declared_scan(spark, table_path(SF001, "nation"), "n_nationkey bigint, n_name string, n_regionkey bigint")
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "bigint"]
    assert df.agg({"n_nationkey": "sum"}).first()[0] == sum(range(25))


@pytest.mark.parametrize(
    "schema",
    [
        "n_nationkey string, n_name string, n_regionkey int",  # int -> string
        "n_nationkey int, n_name string",  # extra column in the file
        "n_nationkey int, n_name string, n_regionkey int, n_comment string",  # missing
        "n_name string, n_nationkey int, n_regionkey int",  # order
        "n_nationkey bigint, n_name string, n_regionkey smallint",  # narrowing
    ],
)
def test_rejects_before_reading_data(spark, schema):
    def run():
        with pytest.raises(SchemaMismatch):
            declared_scan(spark, table_path(SF001, "nation"), schema)

    # Only the footer read that any Parquet open does; no scan of the data.
    baseline = _jobs(spark, lambda: spark.read.parquet(table_path(SF001, "nation")).schema, f"base-{hash(schema)}")
    assert len(_jobs(spark, run, f"check-{hash(schema)}")) == len(baseline)


def test_every_test_table_matches_its_declaration(spark):
    for name in TABLE_SCHEMAS:
        df = read_table(spark, SF001, name)
        assert schema_problems(df.schema, as_struct(TABLE_SCHEMAS[name])) == []


def test_pushdown_survives(spark):
    df = read_table(spark, SF001, "orders").filter("o_custkey = 7").select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,7)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


DRIFTED = {
    "missing": ("k int", [(1,)]),
    "extra": ("k int, v string, w int", [(1, "a", 2)]),
    "order": ("v string, k int", [("a", 1)]),
    "type": ("k string, v string", [("1", "a")]),
    "narrower": ("k smallint, v string", [(1, "a")]),
}


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
@pytest.mark.parametrize("fault", sorted(DRIFTED))
def test_every_file_is_checked(spark, fault, fmt):
    from parlance.session import fresh_path

    path = fresh_path(spark, "drift")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.format(fmt).save(path)
    schema, rows = DRIFTED[fault]
    spark.createDataFrame(rows, schema).coalesce(1).write.format(fmt).mode("append").save(path)
    with pytest.raises(SchemaMismatch):
        declared_scan(spark, path, "k int, v string", fmt=fmt)


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_files_may_mix_int_and_bigint(spark, fmt):
    from parlance.session import fresh_path

    path = fresh_path(spark, "drift")
    spark.createDataFrame([(1, "a")], "k int, v string").coalesce(1).write.format(fmt).save(path)
    spark.createDataFrame([(2**40, "b")], "k bigint, v string").coalesce(1).write.format(fmt).mode("append").save(path)
    df = declared_scan(spark, path, "k bigint, v string", fmt=fmt)
    assert sorted(r["k"] for r in df.collect()) == [1, 2**40]
    assert df.filter("k = 1").count() == 1
    with pytest.raises(SchemaMismatch):
        declared_scan(spark, path, "k int, v string", fmt=fmt)


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_many_files_are_checked_by_distinct_footers(spark, fmt, monkeypatch):
    from parlance.session import fresh_path
    from parlance.sources import declared as d

    path = fresh_path(spark, "many")
    spark.range(0, 40, 1, 20).selectExpr("CAST(id AS int) AS k", "'a' AS v").write.format(fmt).save(path)
    assert spark.read.format(fmt).load(path).rdd.getNumPartitions() > 0
    assert d.data_files(spark, path).count() == 20 and len(list(d.one_file_per_footer(spark, path, fmt))) == 1
    assert declared_scan(spark, path, "k bigint, v string", fmt=fmt).count() == 40
    spark.createDataFrame([(1,)], "k int").coalesce(1).write.format(fmt).mode("append").save(path)
    with pytest.raises(SchemaMismatch, match="missing"):
        declared_scan(spark, path, "k bigint, v string", fmt=fmt)
    found, why = d._footer_print("nosuchstore://x/y.parquet", fmt)
    assert found is None and why


def _small_files(spark, n, schema="k bigint, v string"):
    """A folder of ``n`` files, copies of one that Spark wrote."""
    import shutil

    from parlance.session import fresh_path, local_path

    path = fresh_path(spark, "small")
    spark.createDataFrame([(1, "a")], schema).coalesce(1).write.parquet(path)
    folder = local_path(path)
    first = next(f for f in os.listdir(folder) if f.endswith(".parquet"))
    for i in range(n - 1):
        shutil.copyfile(f"{folder}/{first}", f"{folder}/copy-{i:05d}.parquet")
    return path, folder, first


def test_ten_thousand_files_in_one_job_a_footer(spark):
    path, folder, first = _small_files(spark, 10_000)
    sc = spark.sparkContext

    def jobs(group):
        sc.setJobGroup(group, group)
        try:
            df = declared_scan(spark, path, "k bigint, v string")
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        return df, len(sc.statusTracker().getJobIdsForGroup(group))

    plain = len(sc.statusTracker().getJobIdsForGroup("small-none"))
    df, n = jobs("small-one")
    # Spark's own inference (1), the footers (a shuffle's map side and its result), one schema
    assert plain == 0 and n <= 4
    assert df.count() == 10_000
    spark.createDataFrame([(2, "b", 3)], "k bigint, v string, w int").coalesce(1).write.mode("append").parquet(path)
    with pytest.raises(SchemaMismatch, match="not declared|extra|w"):
        jobs("small-two")


def test_file_without_rows_and_odd_names_are_checked(spark):
    from parlance.session import fresh_path, local_path

    path = fresh_path(spark, "odd") + "/a b{1}%41"
    spark.createDataFrame([(1, "a")], "k bigint, v string").coalesce(1).write.parquet(path)
    spark.createDataFrame([], "k bigint, v string").coalesce(1).write.mode("append").parquet(path)
    assert declared_scan(spark, _escaped(path), "k bigint, v string").count() == 1
    spark.createDataFrame([], "k bigint, v string, w int").coalesce(1).write.mode("append").parquet(path)
    assert len([f for f in os.listdir(local_path(path)) if f.endswith(".parquet")]) == 3
    with pytest.raises(SchemaMismatch):
        declared_scan(spark, _escaped(path), "k bigint, v string")


def _escaped(path):
    """Names are patterns to Spark's readers."""
    return path.replace("{", "\\{").replace("}", "\\}")


def test_footers_no_reader_opens_here_are_read_by_spark(spark, monkeypatch):
    """A store that only Spark's readers know: every file is checked all the same."""
    from parlance.sources import declared as d

    path, folder, first = _small_files(spark, 5)
    real = d.footer_prints

    def shut(spark, path, fmt):
        none = F.lit(None).cast("string")
        return real(spark, path, fmt).withColumns({"print": none, "why": F.lit("unknown store")})

    monkeypatch.setattr(d, "footer_prints", shut)
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        assert declared_scan(spark, path, "k bigint, v string").count() == 5
    assert any("5 footers" in str(w.message) and "unknown store" in str(w.message) for w in told)
    spark.createDataFrame([(2,)], "k bigint").coalesce(1).write.mode("append").parquet(path)
    with pytest.raises(SchemaMismatch):
        declared_scan(spark, path, "k bigint, v string")


def test_a_broken_file_is_named(spark):
    path, folder, first = _small_files(spark, 3)
    with open(f"{folder}/copy-00001.parquet", "wb") as f:
        f.write(b"no parquet")
    with pytest.warns(UserWarning, match="copy-00001"), pytest.raises(Exception, match="copy-00001"):
        declared_scan(spark, path, "k bigint, v string")


def test_partitioned_table_is_checked_file_by_file(spark):
    from parlance.session import fresh_path

    path = fresh_path(spark, "parts")
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, p int")
    df.write.partitionBy("p").parquet(path)
    got = declared_scan(spark, path, "k bigint, v string, p int")
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1), (2, "b", 2)]
    spark.createDataFrame([(3,)], "k int").write.parquet(f"{path}/p=3")
    with pytest.raises(SchemaMismatch, match="p=3"):
        declared_scan(spark, path, "k bigint, v string, p int")


def test_orc_and_rejects_schemaless_formats(spark):
    from parlance.session import fresh_path

    path = fresh_path(spark, "orc")
    spark.read.parquet(table_path(SF001, "nation")).write.orc(path)
    assert declared_scan(spark, path, NATION, fmt="orc").count() == 25
    with pytest.raises(ValueError):
        declared_scan(spark, path, NATION, fmt="csv")
