"""O1 options only: running it needs a database, which these tests do not start."""

import pytest

from parlance.sources.jdbc import jdbc_options


def test_split_options():
    o = jdbc_options("jdbc:x://h/db", "supplier", "org.x.Driver", "s_suppkey", 0, 999, 4)
    assert o["partitionColumn"] == "s_suppkey"
    assert (o["lowerBound"], o["upperBound"], o["numPartitions"]) == ("0", "999", "4")
    assert o["preferTimestampNTZ"] == "true"


def test_unsplit_options():
    o = jdbc_options("jdbc:x://h/db", "supplier", "org.x.Driver")
    assert "partitionColumn" not in o


@pytest.mark.parametrize(
    "args",
    [("k", 0, 10, None), ("k", 10, 0, 2), ("k", 0, 10, 0), (None, 0, 10, 2)],
)
def test_bad_split(args):
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x://h/db", "t", "d", *args)


def test_where_split_needs_predicates(spark):
    from parlance.sources.jdbc import jdbc_scan_where

    with pytest.raises(ValueError):
        jdbc_scan_where(spark, "jdbc:x://h/db", "t", "d", [])


@pytest.mark.parametrize("table,key", [("t; DROP TABLE x", "k"), ("t", "k) FROM t --")])
def test_key_bounds_rejects_non_identifiers(spark, table, key):
    from parlance.sources.jdbc import jdbc_key_bounds

    with pytest.raises(ValueError):
        jdbc_key_bounds(spark, "jdbc:x://h/db", table, "d", key)


def test_catalog_conf():
    from parlance.sources.jdbc import jdbc_catalog_conf

    conf = jdbc_catalog_conf("db", "jdbc:x://h/db", "org.x.Driver", fetchsize=1000)
    assert conf["spark.sql.catalog.db"].endswith("JDBCTableCatalog")
    assert conf["spark.sql.catalog.db.pushDownAggregate"] == "true"
    assert conf["spark.sql.catalog.db.fetchsize"] == "1000"
    with pytest.raises(ValueError):
        jdbc_catalog_conf("a.b", "u", "d")


# ---------------------------------------------------------------- equi-depth split
D = __import__("datetime")
KEYS = {
    "int": ([5, -3, 5, 5, 0, 9, None, 2**40, None, 5, -3], "BIGINT"),
    "text": (["b", "", "it's", "Z", "b", None, "zz", "b"], "VARCHAR"),
    "date": ([D.date(2024, 1, 1), D.date(1999, 12, 31), None, D.date(2024, 1, 1)], "DATE"),
    "time": ([D.datetime(2024, 1, 1, 2, 3, 4, 500), D.datetime(2023, 5, 6), None], "TIMESTAMP"),
    "decimal": ([__import__("decimal").Decimal(x) for x in ("1.50", "-2.25", "1.50", "1000000")], "DECIMAL(18,2)"),
    "none": ([None, None], "BIGINT"),
    "empty": ([], "BIGINT"),
}


@pytest.mark.parametrize("name", KEYS)
@pytest.mark.parametrize("parts", [1, 2, 3, 50])
def test_every_row_is_in_exactly_one_range(name, parts):
    """The predicates and the query for their bounds, run by an engine inside this process."""
    import duckdb

    from parlance.sources.jdbc import quantile_query, range_predicates

    keys, kind = KEYS[name]
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t (i INTEGER, k {kind})")
    for i, k in enumerate(keys):
        con.execute("INSERT INTO t VALUES (?, ?)", [i, k])
    bounds = sorted(r[0] for r in con.execute(f"SELECT * FROM {quantile_query('t', 'k', parts)}").fetchall())
    for cuts in (bounds[1:], bounds, bounds * 2, []):
        found = [r[0] for p in range_predicates("k", cuts) for r in con.execute(f"SELECT i FROM t WHERE {p}").fetchall()]
        assert sorted(found) == list(range(len(keys)))


def test_ranges_are_even_where_strides_are_not():
    import duckdb

    from parlance.sources.jdbc import quantile_query, range_predicates

    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT CAST(pow(1.02, range) AS BIGINT) AS k FROM range(0, 2000)")
    bounds = sorted(r[0] for r in con.execute(f"SELECT * FROM {quantile_query('t', 'k', 8)}").fetchall())
    sizes = [con.execute(f"SELECT count(*) FROM t WHERE {p}").fetchone if False else con.execute(f"SELECT count(*) FROM t WHERE {p}").fetchall()[0][0] for p in range_predicates("k", bounds[1:])]
    assert sum(sizes) == 2000 and sizes[-1] == 0 and max(sizes[:-1]) <= 2 * 250


@pytest.mark.parametrize("name", ["int", "date", "decimal"])
def test_ranges_hold_in_spark_sql_too(spark, name):
    from parlance.sources.jdbc import range_predicates

    keys, _ = KEYS[name]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k " + {"int": "bigint", "date": "date", "decimal": "decimal(18,2)"}[name])
    cuts = [k for k in keys if k is not None]
    found = [r[0] for p in range_predicates("k", cuts) for r in df.where(p).select("i").collect()]
    assert sorted(found) == list(range(len(keys)))
    assert sum(df.where(p).count() for p in range_predicates("k", cuts, nullable=False)) == len(cuts)


@pytest.mark.parametrize("bad", [[True], [1.5], [float("nan")], [None], [1, "a"], [__import__("decimal").Decimal("NaN")]])
def test_bad_bounds(bad):
    from parlance.sources.jdbc import range_predicates

    with pytest.raises((ValueError, TypeError, ArithmeticError)):
        range_predicates("k", bad)


@pytest.mark.parametrize("table, key, parts", [("t; drop", "k", 2), ("t", "k)", 2), ("t", "k", 0)])
def test_bad_quantile_queries(table, key, parts):
    from parlance.sources.jdbc import quantile_query

    with pytest.raises(ValueError):
        quantile_query(table, key, parts)
