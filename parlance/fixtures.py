"""Stand-in inputs built from the test tables.

These only shape rows into the schemas the operators expect; they do none
of the operators' work. The verbs are invented for testing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.dispatch import Catalogue, lookup_table, union_lookups
from parlance.sources.tables import read_table

# The test command set, verb -> number of arguments.
TEST_CATALOGUE = Catalogue([("customer", 1), ("order", 1), ("supplier", 1)])


def command_lines(events: DataFrame) -> DataFrame:
    """One command line per event: ``(line_id, ts, line)``.

    view -> ``customer <user_id>``; click -> two spaces, ``ORDER``, three
    spaces, ``<event_id * 2>``; purchase -> ``supplier <user_id>``;
    signup -> ``supplier``; error -> ``ban <user_id>``; anything else -> null.
    """
    et = F.col("event_type")
    uid = F.col("user_id").cast("string")
    line = (
        F.when(et == "view", F.concat(F.lit("customer "), uid))
        .when(et == "click", F.concat(F.lit("  ORDER   "), (F.col("event_id") * 2).cast("string")))
        .when(et == "purchase", F.concat(F.lit("supplier "), uid))
        .when(et == "signup", F.lit("supplier"))
        .when(et == "error", F.concat(F.lit("ban "), uid))
    )
    return events.select(
        F.col("event_id").alias("line_id"), F.col("ts"), line.alias("line")
    )


def lookup_rows(customer: DataFrame, orders: DataFrame, supplier: DataFrame) -> DataFrame:
    """``(verb, key, body)`` answers for the three test verbs."""
    return union_lookups(
        [
            lookup_table(
                customer, "customer", "c_custkey",
                F.concat_ws(" ", F.col("c_name"), F.col("c_mktsegment")),
            ),
            lookup_table(
                orders, "order", "o_orderkey",
                F.concat_ws(" ", F.col("o_orderstatus"), F.col("o_orderpriority")),
            ),
            lookup_table(supplier, "supplier", "s_suppkey", F.col("s_name")),
        ]
    )


# The commands of the variant lines, verb -> number of arguments.
VARIANT_CATALOGUE = Catalogue([*TEST_CATALOGUE.entries, ("price", 2)])


def variant_lines(events: DataFrame) -> DataFrame:
    """One line per event, of ten shapes: no text, blanks only, tabs, one to
    three arguments, negative, signed and overflowing keys, an unknown verb."""
    uid, eid = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    shapes = [
        F.lit(None).cast("string"),
        F.lit(" \t "),
        F.concat(F.lit("\tCustomer\t"), uid, F.lit(" ")),
        F.concat(F.lit("price "), uid, F.lit(" "), eid),
        F.concat(F.lit("price "), uid),
        F.concat(F.lit("customer -"), uid),
        F.concat(F.lit("order 99999999999999999999"), uid),
        F.concat(F.lit("supplier "), uid, F.lit(" "), eid, F.lit(" x")),
        F.concat(F.lit("supplier +"), uid),
        F.concat(F.lit("Mute "), uid, F.lit(" "), eid),
    ]
    shape = F.pmod(F.col("event_id"), F.lit(len(shapes)))
    line = F.lit(None).cast("string")
    for i, text in enumerate(shapes):
        line = F.when(shape == i, text).otherwise(line)
    return events.select(F.col("event_id").alias("line_id"), F.col("ts"), line.alias("line"))


def load_variant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_lines(read_table(spark, sf_dir, "events"))


def load_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return command_lines(read_table(spark, sf_dir, "events"))


def load_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_rows(
        read_table(spark, sf_dir, "customer"),
        read_table(spark, sf_dir, "orders"),
        read_table(spark, sf_dir, "supplier"),
    )


# SQL (DuckDB dialect) for the same stand-in inputs, used by the oracles.
LINES_SQL = """
SELECT event_id AS line_id, ts,
       CASE event_type
         WHEN 'view' THEN 'customer ' || CAST(user_id AS VARCHAR)
         WHEN 'click' THEN '  ORDER   ' || CAST(event_id * 2 AS VARCHAR)
         WHEN 'purchase' THEN 'supplier ' || CAST(user_id AS VARCHAR)
         WHEN 'signup' THEN 'supplier'
         WHEN 'error' THEN 'ban ' || CAST(user_id AS VARCHAR)
       END AS line
FROM events
"""

VARIANT_LINES_SQL = """
SELECT event_id AS line_id, ts,
       CASE event_id % 10
         WHEN 1 THEN ' ' || chr(9) || ' '
         WHEN 2 THEN chr(9) || 'Customer' || chr(9) || user_id || ' '
         WHEN 3 THEN 'price ' || user_id || ' ' || event_id
         WHEN 4 THEN 'price ' || user_id
         WHEN 5 THEN 'customer -' || user_id
         WHEN 6 THEN 'order 99999999999999999999' || user_id
         WHEN 7 THEN 'supplier ' || user_id || ' ' || event_id || ' x'
         WHEN 8 THEN 'supplier +' || user_id
         WHEN 9 THEN 'Mute ' || user_id || ' ' || event_id
       END AS line
FROM events
"""

LOOKUPS_SQL = """
SELECT 'customer' AS verb, c_custkey AS key, concat_ws(' ', c_name, c_mktsegment) AS body FROM customer
UNION ALL
SELECT 'order', o_orderkey, concat_ws(' ', o_orderstatus, o_orderpriority) FROM orders
UNION ALL
SELECT 'supplier', s_suppkey, s_name FROM supplier
"""

CATALOGUE_SQL = """
SELECT * FROM (VALUES ('customer', 1), ('order', 1), ('supplier', 1)) AS c(verb, arity)
"""
