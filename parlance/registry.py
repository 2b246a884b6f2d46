"""The registered queries, one per operator, and their DuckDB oracles.

Every query reads the whole test tables (or data Spark derives from them);
none filters to an id subset or caps rows, except ``log_tail`` whose limit
is the operator itself.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parlance.fixtures import (
    CATALOGUE_SQL,
    LINES_SQL,
    LOOKUPS_SQL,
    TEST_CATALOGUE,
    VARIANT_CATALOGUE,
    VARIANT_LINES_SQL,
    load_lines,
    load_lookups,
    load_variant_lines,
)
from parlance.operators.dispatch import (
    dispatch_commands,
    lookup_table,
    observe_statuses,
    union_lookups,
    unknown_commands,
)
from parlance.operators.log import log_append, read_log, read_log_tail
from parlance.operators.parse import parse_commands, register_parse
from parlance.plans.sql import sql_query
from parlance.session import fresh_path
from parlance.sources.tables import TABLE_SCHEMAS, read_table
from parlance.streaming.dispatch import (
    read_appended,
    read_stream_output,
    stream_append,
    stream_dispatch,
)

# ---------------------------------------------------------------- O2
# lineitem declared with l_linenumber widened from int to bigint.
LINEITEM_DECLARED = TABLE_SCHEMAS["lineitem"].replace("l_linenumber int", "l_linenumber bigint")


def q_declared_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: all of lineitem, checked against its declared schema (with one widening)."""
    return read_table(spark, sf_dir, "lineitem", LINEITEM_DECLARED)


SQL_DECLARED_SCAN = """
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
FROM lineitem
"""

# ---------------------------------------------------------------- O3
ORDERS_BY_SEGMENT = """
SELECT c.c_mktsegment, o.o_orderpriority,
       count(*) AS n_orders,
       CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_price,
       count_if(o.o_orderdate = :day) AS n_on_day,
       min(o.o_orderdate) AS first_order,
       max(o.o_orderdate) AS last_order
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
WHERE o.o_orderdate >= :since AND o.o_orderstatus = :status
GROUP BY c.c_mktsegment, o.o_orderpriority
"""
ORDERS_BY_SEGMENT_ARGS = {
    "since": dt.date(1995, 1, 1),
    "status": "F",
    "day": dt.datetime(1996, 1, 2),
}


def q_sql_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: orders joined to customers and grouped, with bound date, status and time."""
    tables = {name: read_table(spark, sf_dir, name) for name in ("orders", "customer")}
    # Private view names: the caller's session keeps any views of its own.
    return sql_query(spark, tables, ORDERS_BY_SEGMENT, ORDERS_BY_SEGMENT_ARGS, placeholders=True)


SQL_SQL_QUERY = (
    ORDERS_BY_SEGMENT.replace("{orders}", "orders")
    .replace("{customer}", "customer")
    .replace(":since", "TIMESTAMP '1995-01-01 00:00:00'")
    .replace(":status", "'F'")
    .replace(":day", "TIMESTAMP '1996-01-02 00:00:00'")
    .replace("count_if(", "count(*) FILTER (")
)

# ---------------------------------------------------------------- O4
def q_parse_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O4: every command line split into verb and arguments."""
    return parse_commands(load_lines(spark, sf_dir)).select("line_id", "ts", "line", "verb", "args")


def _parsed_sql(lines_sql: str) -> str:
    return f"""
lines AS ({lines_sql}),
tokenized AS (
  SELECT *, list_filter(string_split_regex(line, '[ \\t\\r\\n\\f]+'), lambda v: v <> '') AS tok
  FROM lines),
parsed AS (SELECT * EXCLUDE (tok), lower(tok[1]) AS verb, tok[2:] AS args FROM tokenized)
"""


_PARSED_SQL = _parsed_sql(LINES_SQL)

SQL_PARSE_COMMANDS = f"WITH {_PARSED_SQL} SELECT line_id, ts, line, verb, args FROM parsed"

_TEXTS_SQL = """
SELECT doc_id, CAST(NULL AS BIGINT) AS turn, text AS line FROM documents
UNION ALL SELECT conv_id, turn, text FROM conversations
"""
SQL_PARSE_TEXTS = f"WITH {_parsed_sql(_TEXTS_SQL)} SELECT doc_id, turn, verb, args FROM parsed"



def q_parse_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O4 as a SQL table function, over the union of command lines and whole texts."""
    register_parse(spark)
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_id"), F.col("text").alias("line"))
    return sql_query(
        spark, {"lines": load_lines(spark, sf_dir).select("line_id", "line"), "docs": docs},
        """SELECT l.line_id, p.verb, p.args
        FROM (SELECT line_id, line FROM {lines} UNION ALL SELECT line_id, line FROM {docs}) l,
             LATERAL parse_command(l.line) p""",
        placeholders=True,
    )


_UNION_SQL = f"SELECT line_id, line FROM ({LINES_SQL}) UNION ALL SELECT doc_id, text FROM documents"
SQL_PARSE_FUNCTION = f"WITH {_parsed_sql(_UNION_SQL)} SELECT line_id, verb, args FROM parsed"

# ---------------------------------------------------------------- O5
def q_dispatch_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O5: every line answered from the customer, orders and supplier lookups."""
    return dispatch_commands(load_lines(spark, sf_dir), TEST_CATALOGUE, load_lookups(spark, sf_dir))


def q_dispatch_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O5 by the strategy for large lookups: requested keys filter the lookup scans."""
    return dispatch_commands(
        load_lines(spark, sf_dir), TEST_CATALOGUE, load_lookups(spark, sf_dir), strategy="pruned"
    )


def q_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O5: lines per status, counted in passing while all replies are logged."""
    seen = Observation()
    log_append(observe_statuses(q_dispatch_variants(spark, sf_dir), seen), fresh_path(spark, "reply-log"), ordered=False)
    rows = [(k, v) for k, v in seen.get.items() if v]
    return spark.createDataFrame(rows, "status string, lines bigint")


def q_dispatch_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O5 over lines of every status: blank, tabbed, with one to three arguments,
    negative and overflowing keys, and a command of two arguments."""
    lookups = union_lookups(
        [
            load_lookups(spark, sf_dir),
            lookup_table(
                read_table(spark, sf_dir, "part"), "price", "p_partkey", F.col("p_brand")
            ),
        ]
    )
    return dispatch_commands(load_variant_lines(spark, sf_dir), VARIANT_CATALOGUE, lookups)


def q_parse_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O4 over the whole texts of all documents and conversations."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("bigint").alias("turn"), "text")
    turns = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), "turn", "text"
    )
    parsed = parse_commands(docs.unionByName(turns), col="text")
    return parsed.select("doc_id", "turn", "verb", "args")


def q_unknown_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O5: the lines whose verb is not in the catalogue."""
    return unknown_commands(load_lines(spark, sf_dir), TEST_CATALOGUE)


def _replies_sql(parsed_sql: str, catalogue_sql: str, lookups_sql: str) -> str:
    return f"""
{parsed_sql},
cat AS ({catalogue_sql}),
lk AS ({lookups_sql}),
keyed AS (
  SELECT p.*, c.arity,
         CASE WHEN regexp_full_match(p.args[1], '-?[0-9]+')
              THEN TRY_CAST(p.args[1] AS BIGINT) END AS key
  FROM parsed p LEFT JOIN cat c ON p.verb = c.verb),
classified AS (
  SELECT k.line_id, k.ts, k.verb,
         CASE WHEN k.verb IS NULL THEN 'blank'
              WHEN k.arity IS NULL THEN 'unknown_command'
              WHEN len(k.args) <> k.arity OR k.key IS NULL THEN 'bad_arguments'
              WHEN lk.verb IS NULL THEN 'not_found'
              ELSE 'ok' END AS status,
         lk.body
  FROM keyed k LEFT JOIN lk ON k.verb = lk.verb AND k.key = lk.key),
replies AS (
  SELECT line_id, ts, verb, status,
         CASE WHEN status = 'ok' THEN body ELSE status END AS reply
  FROM classified)
"""


_REPLIES_SQL = _replies_sql(_PARSED_SQL, CATALOGUE_SQL, LOOKUPS_SQL)

SQL_DISPATCH_COMMANDS = f"WITH {_REPLIES_SQL} SELECT * FROM replies"

_VARIANT_CATALOGUE_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{verb}', {arity})" for verb, arity in VARIANT_CATALOGUE.entries
) + ") AS c(verb, arity)"
_VARIANT_LOOKUPS_SQL = f"{LOOKUPS_SQL} UNION ALL SELECT 'price', p_partkey, p_brand FROM part"
SQL_DISPATCH_VARIANTS = "WITH " + _replies_sql(
    _parsed_sql(VARIANT_LINES_SQL), _VARIANT_CATALOGUE_SQL, _VARIANT_LOOKUPS_SQL
) + " SELECT * FROM replies"

SQL_STATUS_COUNTS = f"""
SELECT coalesce(status, 'lines') AS status, count(*) AS lines FROM ({SQL_DISPATCH_VARIANTS})
GROUP BY ROLLUP (status)
"""

SQL_UNKNOWN_COMMANDS = f"""
WITH {_PARSED_SQL}, cat AS ({CATALOGUE_SQL})
SELECT line_id, ts, line, verb FROM parsed
WHERE verb IS NOT NULL AND verb NOT IN (SELECT verb FROM cat)
"""

# ---------------------------------------------------------------- O6, O7
def _write_log(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "reply-log")
    log_append(q_dispatch_commands(spark, sf_dir), path)
    return path


def q_log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O6: the replies appended to a new log and read back."""
    return read_log(spark, _write_log(spark, sf_dir))


LOG_TAIL_N = 100


def q_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O7: the newest 100 rows of a log holding all the replies."""
    return read_log_tail(spark, _write_log(spark, sf_dir), LOG_TAIL_N)


SQL_LOG_TAIL = (
    f"WITH {_REPLIES_SQL} SELECT * FROM replies "
    f"ORDER BY ts DESC, line_id DESC LIMIT {LOG_TAIL_N}"
)

# ---------------------------------------------------------------- O8
STREAM_ROWS_PER_FILE = 50_000
STREAM_FILES_PER_BATCH = 8


def _stream(spark: SparkSession, sf_dir: str, run: Callable) -> str:
    """Lines land as files in arrival (line_id) order, as many as the rows need;
    ``run`` answers them in micro-batches of a few files and stops. The output folder."""
    in_dir = fresh_path(spark, "stream-in")
    out_dir = fresh_path(spark, "stream-out")
    ckpt = fresh_path(spark, "stream-ckpt")
    lines = load_lines(spark, sf_dir)
    files = max(2, -(-lines.count() // STREAM_ROWS_PER_FILE))
    lines.repartitionByRange(files, "line_id").write.parquet(in_dir)
    q = run(
        spark, in_dir, out_dir, ckpt, TEST_CATALOGUE, load_lookups(spark, sf_dir),
        max_files_per_trigger=max(1, min(STREAM_FILES_PER_BATCH, files // 2)),
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"stream failed: {q.exception()}")
    return out_dir


def q_stream_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O8: lines answered as they arrive, micro-batch by micro-batch, into the log."""
    return read_stream_output(spark, _stream(spark, sf_dir, stream_dispatch))


def q_stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O8 by one streaming plan into Spark's file sink."""
    return read_appended(spark, _stream(spark, sf_dir, stream_append))


# ---------------------------------------------------------------- wiring
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "declared_scan": q_declared_scan,
    "sql_query": q_sql_query,
    "parse_commands": q_parse_commands,
    "parse_texts": q_parse_texts,
    "dispatch_commands": q_dispatch_commands,
    "dispatch_variants": q_dispatch_variants,
    "unknown_commands": q_unknown_commands,
    "log_append": q_log_append,
    "log_tail": q_log_tail,
    "stream_dispatch": q_stream_dispatch,
    "stream_append": q_stream_append,
    "dispatch_pruned": q_dispatch_pruned,
    "status_counts": q_status_counts,
    "parse_function": q_parse_function,
}

ORACLE_SQL: dict[str, str] = {
    "declared_scan": SQL_DECLARED_SCAN,
    "sql_query": SQL_SQL_QUERY,
    "parse_commands": SQL_PARSE_COMMANDS,
    "parse_texts": SQL_PARSE_TEXTS,
    "dispatch_commands": SQL_DISPATCH_COMMANDS,
    "dispatch_variants": SQL_DISPATCH_VARIANTS,
    "unknown_commands": SQL_UNKNOWN_COMMANDS,
    "log_append": SQL_DISPATCH_COMMANDS,
    "log_tail": SQL_LOG_TAIL,
    "stream_dispatch": SQL_DISPATCH_COMMANDS,
    "stream_append": SQL_DISPATCH_COMMANDS,
    "dispatch_pruned": SQL_DISPATCH_COMMANDS,
    "status_counts": SQL_STATUS_COUNTS,
    "parse_function": SQL_PARSE_FUNCTION,
}
