"""parlance: answer short text commands in bulk on Spark.

Sources (``declared_scan``, ``jdbc_scan``), parameterised SQL
(``sql_query``), command parsing and dispatch (``parse_commands``,
``dispatch_commands``, ``unknown_commands``), an append-only reply log
(``log_append``, ``read_log_tail``) and streaming dispatchers
(``stream_dispatch`` into that log, ``stream_append`` into plain files).
"""

from parlance.operators.answers import Answers, AnswerTable
from parlance.operators.dispatch import (
    Catalogue,
    LookupCheck,
    bucket_lookups,
    check_lookups,
    check_unique_lookups,
    dispatch_commands,
    lookup_table,
    observe_statuses,
    union_lookups,
    unknown_commands,
)
from parlance.operators.log import (
    LogLayoutError,
    compact_day,
    index_batches,
    log_append,
    log_tail,
    log_write_batch,
    read_log,
    read_log_tail,
)
from parlance.operators.parse import parse_commands, register_parse
from parlance.plans.sql import sql_query
from parlance.sources.declared import SchemaMismatch, declared_scan
from parlance.sources.jdbc import jdbc_scan, jdbc_scan_equi_depth, jdbc_scan_where
from parlance.streaming.dispatch import (
    read_appended,
    read_stream_output,
    stream_append,
    stream_dispatch,
)

__all__ = [
    "AnswerTable",
    "Answers",
    "Catalogue",
    "LogLayoutError",
    "LookupCheck",
    "SchemaMismatch",
    "bucket_lookups",
    "check_lookups",
    "check_unique_lookups",
    "compact_day",
    "declared_scan",
    "dispatch_commands",
    "index_batches",
    "jdbc_scan",
    "jdbc_scan_equi_depth",
    "jdbc_scan_where",
    "log_append",
    "log_tail",
    "log_write_batch",
    "lookup_table",
    "observe_statuses",
    "parse_commands",
    "read_appended",
    "read_log",
    "read_log_tail",
    "read_stream_output",
    "register_parse",
    "sql_query",
    "stream_append",
    "stream_dispatch",
    "union_lookups",
    "unknown_commands",
]
