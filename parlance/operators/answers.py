"""Answers: lookups aggregated once, written, and joined by many batches.

A table of answers holds one row per ``(verb, key)``: how many lookup rows it has
and the least body. ``AnswerTable`` keeps it under a folder in versions, one per
state of the lookups, so that a run of batches aggregates them once and a
restart finds them ready; only when the lookups change is a new version written.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.lookups import (
    LOOKUP_BROADCAST_MAX_BYTES,
    LOOKUP_BROADCAST_MAX_ROWS,
    _row_bytes,
)

ANSWER_SCHEMA = "verb string, key bigint, n bigint, body string"
VERSION = "version="
# Versions left beside the newest one, for a reader that still has them open.
KEPT = 1

_STATUS = re.compile(r"path=([^;}]*);.*?length=(\d+);.*?modification_time=(\d+)")


@dataclass(frozen=True)
class Answers:
    """A written table of answers: ``verb, key, n, body``, sorted by verb and key."""

    frame: DataFrame
    version: str
    rows: int
    bytes: int

    def fits(
        self, max_rows: int = LOOKUP_BROADCAST_MAX_ROWS, max_bytes: int = LOOKUP_BROADCAST_MAX_BYTES
    ) -> bool:
        """Whether the measured size is safe to broadcast."""
        return self.rows <= max_rows and self.bytes <= max_bytes


def answers_of(lookups: DataFrame) -> DataFrame:
    """One row per ``(verb, key)``: how many lookup rows it has, and the least body."""
    return lookups.groupBy("verb", "key").agg(F.count(F.lit(1)).alias("n"), F.min("body").alias("body"))


def lookup_version(lookups: DataFrame) -> str | None:
    """A digest of what the lookups are made of, or None if that cannot be told.

    It covers the query over the files (the analyzed plan, free of Spark's running
    numbers) and path, length and modification time of every file, from the
    listing that the DataFrame holds already. Anything but files (rows of the
    driver, an RDD, a database) has no version. What a UDF does is not covered.
    """
    spark = lookups.sparkSession
    width = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(width, None)
    try:
        plan = lookups._jdf.queryExecution().analyzed()
        leaves = plan.collectLeaves()
        told = []
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            if leaf.getClass().getSimpleName() != "LogicalRelation":
                return None
            index = leaf.relation().location()
            if not hasattr(index, "allFiles"):
                return None
            listed = index.allFiles().mkString("\n")
            files = sorted(_STATUS.findall(listed))
            if len(files) != listed.count("modification_time="):
                return None
            told.append(repr(files))
        spark.conf.set(width, "100000")
        told.append(plan.canonicalized().toString())
    except Exception:  # noqa: BLE001 - a Connect session, or a source with no listing
        return None
    finally:
        if before is None:
            spark.conf.unset(width)
        else:
            spark.conf.set(width, before)
    return hashlib.sha256("\n".join(told).encode()).hexdigest()[:32]


class AnswerTable:
    """The newest answers of lookups that may change, under ``path``.

    ``path`` belongs in the shared folder, and to one writer (a stream).
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.built = 0
        self._now: Answers | None = None

    def current(self, lookups: DataFrame, version: str | None = None) -> Answers:
        """The answers of ``lookups``, written first if this version is not there.

        ``version`` is taken from :func:`lookup_version` unless given; where there
        is none, every call writes.
        """
        version = version or lookup_version(lookups) or f"once-{uuid.uuid4().hex}"
        if self._now is None or self._now.version != version:
            self._now = self._open(version) or self._build(lookups, version)
            self._drop_old()
        return self._now

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def _open(self, version: str) -> Answers | None:
        path = f"{self.path}/{VERSION}{version}"
        fs, done = self._fs(f"{path}/_SUCCESS")
        if not fs.exists(done):
            return None
        frame = self.spark.read.schema(ANSWER_SCHEMA).parquet(path)
        size = frame.agg(F.count(F.lit(1)).alias("rows"), F.sum(_row_bytes("verb", "body")).alias("bytes")).first()
        return Answers(frame, version, size["rows"], size["bytes"] or 0)

    def _build(self, lookups: DataFrame, version: str) -> Answers:
        # ranges of (verb, key), sorted: the footers of row groups tell which keys they hold
        (
            answers_of(lookups.select("verb", "key", "body"))
            .repartitionByRange("verb", "key").sortWithinPartitions("verb", "key")
            .write.mode("overwrite").parquet(f"{self.path}/{VERSION}{version}")
        )
        self.built += 1
        return self._open(version)

    def _drop_old(self) -> None:
        fs, root = self._fs(self.path)
        found = [s for s in fs.listStatus(root) if s.getPath().getName().startswith(VERSION)]
        old = [s for s in found if s.getPath().getName() != f"{VERSION}{self._now.version}"]
        old.sort(key=lambda s: s.getModificationTime(), reverse=True)
        for s in old[KEPT:]:
            fs.delete(s.getPath(), True)
