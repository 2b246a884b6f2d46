"""O3: run SQL text with named parameters over a set of tables.

Values are bound as typed literals by Spark's parameter markers
(``:name``); they are never pasted into the text, so a value cannot change
the shape of the query. The tables are registered as temporary views for the
analysis of the statement only, so Catalyst plans the whole of it (pushdown,
pruning, join choice) and the caller's own views stay as they were.
"""

from __future__ import annotations

import datetime as dt
import decimal
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BINDABLE = (bool, int, float, str, decimal.Decimal, dt.date, dt.datetime)
_VIEW_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _bound(value: object) -> object:
    """A naive datetime becomes a timestamp without zone, whatever the session's
    zone; PySpark itself would read it as a local time."""
    if isinstance(value, dt.datetime) and value.tzinfo is None:
        return F.expr(f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'")
    return value


def sql_query(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    text: str,
    args: dict[str, object] | None = None,
    placeholders: bool = False,
) -> DataFrame:
    """Run ``text`` over ``tables`` with ``args`` bound by name.

    The text names the tables as they are; a temporary view of the caller with
    the same name is put back afterwards. With ``placeholders`` the text names
    them as ``{name}`` instead, and each gets a private view name, so concurrent
    queries cannot meet each other's views. Only ``{name}`` of a given table is
    replaced; other braces are plain text.

    Views exist during analysis alone: the returned DataFrame holds the tables'
    own plans. Naive datetimes are bound as ``timestamp_ntz``, datetimes with a
    zone as ``timestamp``.
    """
    args = dict(args or {})
    for name, value in args.items():
        if not _VIEW_NAME.fullmatch(name):
            raise ValueError(f"bad parameter name {name!r}")
        if value is not None and not isinstance(value, _BINDABLE):
            raise TypeError(f"parameter {name!r}: cannot bind {type(value).__name__}")
    for name in tables:
        if not _VIEW_NAME.fullmatch(name):
            raise ValueError(f"bad table name {name!r}")
    views = {name: name for name in tables}
    if placeholders:
        views = {name: f"__p_{uuid.uuid4().hex}" for name in tables}
        text = re.sub(
            r"\{([A-Za-z_][A-Za-z0-9_]*)\}", lambda m: views.get(m[1], m[0]), text
        )
    bound = {name: _bound(value) for name, value in args.items()}
    before = {}
    if not placeholders:
        for name in tables:
            shown = spark.sql(f"SHOW VIEWS LIKE '{name}'").filter("isTemporary")
            if shown.filter("namespace = ''").limit(1).collect():
                before[name] = spark.table(name)
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(views[name])
        return spark.sql(text, args=bound) if bound else spark.sql(text)
    finally:
        for name in tables:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(views[name])
