"""O1: read a database table over JDBC, split over tasks.

Each partition opens its own connection from its executor and reads one
range of ``key``; filters on plain columns and the selected columns are
pushed into the database's query. Timestamps without a zone stay
``timestamp_ntz``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(
    url: str,
    table: str,
    driver: str,
    key: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    parts: int | None = None,
    fetch_size: int = 10_000,
    extra: dict[str, str] | None = None,
) -> dict[str, str]:
    """The reader options for :func:`jdbc_scan`; validated without connecting."""
    opts = {
        "url": url,
        "dbtable": table,
        "driver": driver,
        "fetchsize": str(fetch_size),
        "preferTimestampNTZ": "true",
        "pushDownPredicate": "true",
    }
    split = (key, lower, upper, parts)
    if any(v is not None for v in split):
        if any(v is None for v in split):
            raise ValueError("key, lower, upper and parts go together")
        if parts < 1:
            raise ValueError("parts must be >= 1")
        if lower > upper:
            raise ValueError("lower must not exceed upper")
        opts.update(
            {
                "partitionColumn": key,
                "lowerBound": str(lower),
                "upperBound": str(upper),
                "numPartitions": str(parts),
            }
        )
    for k, v in (extra or {}).items():
        opts[k] = str(v)
    return opts


def jdbc_scan(
    spark: SparkSession,
    url: str,
    table: str,
    driver: str,
    key: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    parts: int | None = None,
    **extra: str,
) -> DataFrame:
    """All rows of ``table``. With ``key``/``lower``/``upper``/``parts`` the
    read is split into ``parts`` key ranges (the bounds only set the stride;
    rows outside them land in the first and last range, none are lost)."""
    opts = jdbc_options(url, table, driver, key, lower, upper, parts, extra=extra)
    return spark.read.format("jdbc").options(**opts).load()


def jdbc_scan_where(
    spark: SparkSession,
    url: str,
    table: str,
    driver: str,
    predicates: list[str],
    **extra: str,
) -> DataFrame:
    """All rows of ``table`` read as one partition per ``WHERE`` predicate,
    for split keys that are not numeric (dates, codes). The predicates must
    not overlap and together must cover every row."""
    if not predicates:
        raise ValueError("give at least one predicate")
    opts = jdbc_options(url, table, driver, extra=extra)
    url = opts.pop("url")
    table = opts.pop("dbtable")
    return spark.read.jdbc(url, table, predicates=list(predicates), properties=opts)


_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*")


def jdbc_key_bounds(spark: SparkSession, url: str, table: str, driver: str, key: str) -> tuple[int, int]:
    """``(min, max)`` of ``key``, computed inside the database (one row back).

    ``table`` and ``key`` must be plain (optionally dotted) identifiers.
    """
    for name in (table, key):
        _plain(name)
    q = f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}) bounds"
    row = jdbc_scan(spark, url, q, driver).first()
    return int(row[0]), int(row[1])


def jdbc_catalog_conf(name: str, url: str, driver: str, **extra: str) -> dict[str, str]:
    """Session settings that mount a database as the v2 catalog ``name``.

    Tables then read as ``spark.table(f"{name}.{schema}.{table}")``. Besides
    filters and columns, this path also pushes aggregates, limits and top-n
    into the database (the plain ``jdbc`` format keeps aggregates in Spark).
    Set these when building the session.
    """
    if not _IDENTIFIER.fullmatch(name) or "." in name:
        raise ValueError(f"not a plain catalog name: {name!r}")
    prefix = f"spark.sql.catalog.{name}"
    conf = {
        prefix: "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog",
        f"{prefix}.url": url,
        f"{prefix}.driver": driver,
        f"{prefix}.pushDownAggregate": "true",
        f"{prefix}.pushDownLimit": "true",
        f"{prefix}.pushDownOffset": "true",
        f"{prefix}.preferTimestampNTZ": "true",
    }
    for k, v in extra.items():
        conf[f"{prefix}.{k}"] = str(v)
    return conf


# ---------------------------------------------------------------- equi-depth split
def sql_literal(value) -> str:
    """A bound as a SQL literal: whole numbers, decimals, text, dates and times."""
    if isinstance(value, bool) or value is None:
        raise ValueError(f"not a split bound: {value!r}")
    if isinstance(value, (int, decimal.Decimal)):
        if isinstance(value, decimal.Decimal) and not value.is_finite():
            raise ValueError(f"not a split bound: {value!r}")
        return str(value) if isinstance(value, int) else format(value, "f")
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            raise ValueError(f"a bound must have no time zone: {value!r}")
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    raise ValueError(f"not a split bound: {value!r}")


def range_predicates(key: str, bounds: Iterable, nullable: bool = True) -> list[str]:
    """``WHERE`` predicates of which each row satisfies exactly one.

    ``bounds`` (in any order, repeats allowed) are where a new range begins: the
    first range is below the least, the last from the greatest on, and rows whose
    key is null have a range of their own (``nullable``). Bounds of one type only.
    """
    _plain(key)
    cuts = sorted(set(bounds))
    if len({type(c) for c in cuts}) > 1:
        raise ValueError("bounds of several types")
    text = [sql_literal(c) for c in cuts]
    if not text:
        ranges = [f"{key} IS NOT NULL"]
    else:
        inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(text, text[1:])]
        ranges = [f"{key} < {text[0]}", *inner, f"{key} >= {text[-1]}"]
    return [*ranges, f"{key} IS NULL"] if nullable else ranges


def quantile_query(table: str, key: str, parts: int) -> str:
    """SQL for the first keys of ``parts`` ranges of equally many rows, as a subquery.

    Ranks inside the database; at most ``parts`` rows come back.
    """
    _plain(table)
    _plain(key)
    if parts < 1:
        raise ValueError("parts must be >= 1")
    ranked = f"SELECT {key} AS k, NTILE({parts}) OVER (ORDER BY {key}) AS t FROM {table} WHERE {key} IS NOT NULL"
    return f"(SELECT MIN(r.k) AS k FROM ({ranked}) r GROUP BY r.t) bounds"


def jdbc_scan_equi_depth(
    spark: SparkSession,
    url: str,
    table: str,
    driver: str,
    key: str,
    parts: int,
    **extra: str,
) -> DataFrame:
    """All rows of ``table``, split into ``parts`` ranges of about equally many rows.

    Equal strides of :func:`jdbc_scan` put most rows of an unevenly filled key into
    few partitions. Here the database ranks the keys once, and each partition reads
    one range by a predicate (an index on ``key`` serves it). A key with many rows
    fills a range of its own; null keys are the last partition. Keys may be numbers,
    text, dates or times; text must sort in the database as in its comparisons.
    """
    rows = jdbc_scan(spark, url, quantile_query(table, key, parts), driver, **extra).collect()
    # the least key begins the first range, which reaches down without a bound
    cuts = sorted(r[0] for r in rows)[1:]
    return jdbc_scan_where(spark, url, table, driver, range_predicates(key, cuts), **extra)


def _plain(name: str) -> None:
    if not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"not a plain identifier: {name!r}")
