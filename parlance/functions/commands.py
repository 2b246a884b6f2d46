"""Column expressions for command lines.

All of these are built-in Spark expressions, so they run inside whole-stage
codegen on the executors; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the command syntax.
# Token separators: space, tab, carriage return, line feed, form feed.
# Vertical tab and no-break space are NOT separators.
SEPARATOR_PATTERN = r"[ \t\r\n\f]+"
# A lookup key: optional minus sign, then decimal digits, nothing else.
KEY_CHARACTERS = "0123456789-"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(line: str | Column) -> Column:
    """Split a line on runs of separators and drop empty tokens.

    A null line gives null; a blank line gives an empty array.
    """
    return F.array_remove(F.split(_col(line), SEPARATOR_PATTERN), "")


def verb_of(toks: str | Column) -> Column:
    """First token, lower-cased; null when there is no token."""
    return F.lower(F.get(_col(toks), 0))


def args_of(toks: str | Column) -> Column:
    """Every token after the first; empty when there is none, null for null."""
    t = _col(toks)
    return F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))


def key_of(args: str | Column, position: int = 0) -> Column:
    """The argument at ``position`` as a bigint, or null when it is missing,
    not a plain integer, or out of the bigint range.

    The cast tells where a minus may stand; that nothing else does (a plus sign,
    blanks of other kinds) is told without a pattern, as Spark builds no runtime
    filter from keys that take a regular expression.
    """
    a = F.get(_col(args), position)
    return F.when(F.translate(a, KEY_CHARACTERS, "") == "", a.try_cast("bigint"))
