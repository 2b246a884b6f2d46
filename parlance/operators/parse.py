"""O4: split command lines into a verb and its arguments."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.commands import SEPARATOR_PATTERN, args_of, tokens, verb_of

_TOKENS = "__parlance_tokens"


def parse_commands(df: DataFrame, col: str = "line") -> DataFrame:
    """Add ``verb string`` and ``args array<string>`` parsed from ``col``.

    A pure projection: no shuffle, and the tokens are computed once per row
    (the temporary column keeps Catalyst from evaluating the split twice).
    """
    if col not in df.columns:
        raise ValueError(f"column {col!r} not in {df.columns}")
    for name in ("verb", "args"):
        if name in df.columns:
            raise ValueError(f"input already has a column named {name!r}")
    with_tokens = df.withColumn(_TOKENS, tokens(col))
    return with_tokens.withColumns(
        {"verb": verb_of(F.col(_TOKENS)), "args": args_of(F.col(_TOKENS))}
    ).drop(_TOKENS)


def register_parse(spark: SparkSession, name: str = "parse_command") -> None:
    """Make ``name(line)`` a table function of this session's SQL: one row ``verb, args``.

    For use beside the lines, over any query, unions too::

        SELECT l.line_id, p.verb, p.args FROM lines l, LATERAL parse_command(l.line) p

    It is a projection as in :func:`parse_commands`, with the same rows: a lateral
    row without a table behind it costs no join.
    """
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a plain function name: {name!r}")
    # parameters cannot be bound in a function's body; the pattern is the library's own
    pattern = SEPARATOR_PATTERN.encode("unicode_escape").decode()
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(line STRING)
        RETURNS TABLE (verb STRING, args ARRAY<STRING>)
        RETURN SELECT lower(get(t, 0)), slice(t, 2, greatest(size(t) - 1, 0))
        FROM (SELECT array_remove(split(line, '{pattern}'), '') AS t)"""
    )
