"""Lookup tables: the answers, as ``(verb, key, body)`` rows.

Building them, storing them bucketed, and measuring them exactly (rows,
bytes, repeated keys) with jobs whose cost stays bounded at any size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.catalogue import _check_verb

LOOKUP_BROADCAST_MAX_ROWS = 2_000_000
LOOKUP_BROADCAST_MAX_BYTES = 256 * 1024 * 1024
# Per answer row besides its strings: key, count, flag and row overhead.
_FIXED_ROW_BYTES = 48


def lookup_table(df: DataFrame, verb: str, key: str | Column, body: Column) -> DataFrame:
    """One command's answers as ``(verb string, key bigint, body string)``.

    ``body`` is cast to string. Doubles print in Spark's form (``1.0E7``);
    cast them to a decimal first when replies must read like another
    engine's output.
    """
    _check_verb(verb)
    k = F.col(key) if isinstance(key, str) else key
    return df.select(
        F.lit(verb).alias("verb"),
        k.cast("bigint").alias("key"),
        body.cast("string").alias("body"),
    )


def union_lookups(parts: Sequence[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("no lookup tables given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bucket_lookups(lookups: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Store the lookups once as a table bucketed and sorted on ``(verb, key)``.

    A join or a uniqueness check on ``(verb, key)`` against the returned
    table needs no shuffle of the lookups; only the lines are shuffled (to
    the same ``buckets`` partitions). This pays off when the same large
    lookups answer many batches. Rows are first hash-partitioned into
    ``buckets`` partitions, the partitioning Spark's bucketing uses, so each
    task writes one file per bucket instead of one per bucket per task.
    Without a shuffle on the lookup side, AQE cannot split a hot-key
    partition of that join; ``dispatch_commands`` splits hot keys itself there.

    ``path`` should be under the shared folder; the table is registered in
    the session catalog as an external table at ``path``.
    """
    if buckets < 1:
        raise ValueError("buckets must be >= 1")
    (
        lookups.select("verb", "key", "body")
        .repartition(buckets, "verb", "key")
        .write.mode("overwrite")
        .bucketBy(buckets, "verb", "key")
        .sortBy("verb", "key")
        .option("path", path)
        .saveAsTable(table)
    )
    return lookups.sparkSession.table(table)


def is_bucketed(lookups: DataFrame) -> bool:
    """Whether the lookups are read from buckets, so that a join need not shuffle them."""
    try:
        plan = lookups._jdf.queryExecution().sparkPlan().toString()
    except AttributeError:  # a Connect session shows no plan objects
        return False
    return "Bucketed: true" in plan


def check_unique_lookups(lookups: DataFrame) -> None:
    """Raise if a ``(verb, key)`` pair has more than one answer.

    A repeated pair would multiply the lines that hit it. The check is one
    aggregation over the two key columns only (partial aggregation runs
    before the shuffle); skip it when the keys are unique by construction.
    """
    dup = (
        lookups.groupBy("verb", "key")
        .count()
        .filter(F.col("count") > 1)
        .limit(1)
        .collect()
    )
    if dup:
        r = dup[0]
        raise ValueError(
            f"lookup key ({r['verb']!r}, {r['key']}) has {r['count']} rows; "
            "keys must be unique"
        )


def _row_bytes(verb: str, body: str) -> Column:
    """Bytes of one (verb, key, body) row: its strings plus a fixed part."""
    return (
        F.octet_length(F.col(verb))
        + F.coalesce(F.octet_length(F.col(body)), F.lit(0))
        + F.lit(_FIXED_ROW_BYTES)
    )


@dataclass(frozen=True)
class LookupCheck:
    """What :func:`check_lookups` found out about a lookup table."""

    rows: int
    fits: bool  # at most max_rows rows and max_bytes bytes: safe to broadcast
    unique: bool | None  # None: not checked, too many rows


def check_lookups(
    lookups: DataFrame,
    max_rows: int = LOOKUP_BROADCAST_MAX_ROWS,
    max_bytes: int = LOOKUP_BROADCAST_MAX_BYTES,
    unique: bool = True,
) -> LookupCheck:
    """Measure the lookups exactly, at a cost that stays bounded at any size.

    First ``count()``: for Parquet it reads no column (row-group metadata),
    and each task sends one number to the final sum. Only when that is at
    most ``max_rows`` are the bytes measured, together with the repeats of
    ``(verb, key)`` when ``unique`` (one aggregation over a table now known
    to be small; without ``unique``, a plain sum with no shuffle). A
    ``limit(n)`` check would not be bounded: every task would send up to
    ``n`` rows to one final task.
    """
    rows = lookups.count()
    if rows > max_rows:
        return LookupCheck(rows, False, None)
    if not unique:
        size = lookups.agg(F.sum(_row_bytes("verb", "body"))).first()[0] or 0
        return LookupCheck(rows, size <= max_bytes, None)
    stats = (
        lookups.groupBy("verb", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes("verb", "body")).alias("b"))
        .agg(F.max("n").alias("repeat"), F.sum("b").alias("bytes"))
        .first()
    )
    return LookupCheck(rows, (stats["bytes"] or 0) <= max_bytes, (stats["repeat"] or 0) <= 1)
