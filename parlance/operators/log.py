"""O6 and O7: an append-only reply log and its newest rows.

Tables have no order, so every row carries ``line_id`` and ``ts`` and the
"newest" rows are defined by ``ts`` descending, ties by ``line_id``
descending, which makes the tail deterministic.

On disk the log is Parquet in one layout for all writers:
``log_date=<day of ts>/writer=<id>/batch_id=<n>``. A tail query skips whole
days; a batch is the pair (writer, batch id), where the writer is one append or
one stream, so no writer can replace another's rows. Readers get the five log
columns only.

Inside a day the files of an append hold ranges of (``ts``, ``line_id``), sorted,
and the batch's folder has an index of them: rows and least and greatest ``ts``
of every file. A tail takes its bound from the index and opens only the files that
reach above it. The index lies in the folder it describes, so a batch that is
written again loses it; a batch without one is read whole.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.sources.declared import as_struct, conform

LOG_SCHEMA = "line_id bigint, ts timestamp_ntz, verb string, status string, reply string"
LOG_PARTITION = "log_date"
WRITER_PARTITION = "writer"
BATCH_PARTITION = "batch_id"
PARTITIONS = (LOG_PARTITION, WRITER_PARTITION, BATCH_PARTITION)
STORED_SCHEMA = f"{LOG_SCHEMA}, {LOG_PARTITION} date, {WRITER_PARTITION} string, {BATCH_PARTITION} bigint"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
# Folder of a compaction under way; readers skip names that begin with "_".
STAGING = "_compact"
# Inside a batch's folder: rows, least and greatest ts of each of its files.
INDEX = "_ranges"
INDEX_SCHEMA = "file string, rows bigint, lo timestamp_ntz, hi timestamp_ntz"
# Begins the name of a writer that never runs again; ids from callers cannot hold a "+".
ANONYMOUS = "+append-"


class LogLayoutError(ValueError):
    """The folder holds something other than a log of this layout."""


def _newest_first():
    return (F.col("ts").desc_nulls_last(), F.col("line_id").desc_nulls_last())


# ---------------------------------------------------------------- folders
def _fs(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its object."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the visible folders in ``path``; none if it does not exist."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n for n in found if not n.startswith(("_", ".")))


def log_days(spark: SparkSession, path: str) -> list[str]:
    """The log's day folders, newest first; the folder of rows without ``ts`` is last."""
    days = [n for n in _folders(spark, path) if n.startswith(f"{LOG_PARTITION}=")]
    return sorted(days, key=lambda n: (not n.endswith(NO_DAY), n), reverse=True)


def _check_layout(spark: SparkSession, path: str) -> None:
    """Raise before writing into a folder that is not a log of this layout."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return
    other = [n for n in _folders(spark, path) if not n.startswith(f"{LOG_PARTITION}=")]
    files = [s.getPath().getName() for s in fs.listStatus(p) if s.isFile()]
    other += [n for n in files if not n.startswith(("_", "."))]
    for day in log_days(spark, path)[:1]:
        other += [
            f"{day}/{n}" for n in _folders(spark, f"{path}/{day}")
            if not n.startswith(f"{WRITER_PARTITION}=")
        ]
        _, d = _fs(spark, f"{path}/{day}")
        inside = [s.getPath().getName() for s in fs.listStatus(d) if s.isFile()]
        other += [f"{day}/{n}" for n in inside if not n.startswith(("_", "."))]
    if other:
        raise LogLayoutError(f"{path} is not a reply log of this layout: it holds {other[:3]}")


# ---------------------------------------------------------------- writing
def log_append(
    df: DataFrame,
    path: str,
    rebalance: bool = True,
    append_id: str | None = None,
    ordered: bool = True,
) -> None:
    """Append ``df`` (checked against the log schema) to the log at ``path``.

    ``rebalance`` shuffles the rows once, so that tasks do not write a file for every
    day each. With ``ordered`` they are range-partitioned and sorted by day, ``ts`` and
    ``line_id``, with partitions merged to the advisory size, and each file holds a
    range of its day; Spark samples the rows to find the ranges, so their last stage is
    worked out twice. Without it they are grouped by day (Spark's rebalance hint), with
    AQE splitting a day that holds too many rows and merging small ones.

    The files are indexed for :func:`read_log_tail` either way. Where their ranges
    overlap, a tail opens more of them.

    Every append is a writer of its own. Given an ``append_id``, an append that
    is repeated after a failure replaces what it wrote before, so a retry adds
    no row twice, compacted or not; without one, a driver lost during the commit can
    leave part of an append behind, and a retry is a new append.
    """
    writer = append_id or f"{ANONYMOUS}{uuid.uuid4().hex}"
    if append_id is not None:
        _check_writer(append_id)
    _write(df, path, writer, 0, ("range" if ordered else "rebalance") if rebalance else None)
    own = _batches(df.sparkSession, path, f"{LOG_PARTITION}=*", f"{WRITER_PARTITION}={writer}")
    index_batches(df.sparkSession, path, own[1])


def log_write_batch(df: DataFrame, path: str, writer: str, batch_id: int) -> None:
    """Write batch ``batch_id`` of ``writer`` idempotently.

    Writing the same batch again (a retry after a failure) replaces exactly its
    folders of the days it has rows for, and nothing of other batches or
    writers.
    """
    _check_writer(writer)
    _write(df, path, writer, batch_id, None)


def _check_writer(writer: str) -> None:
    if not writer or not all(c.isalnum() or c in "-_." for c in writer):
        raise ValueError(f"writer id {writer!r}: letters, digits, '-', '_' and '.' only")


def _write(df: DataFrame, path: str, writer: str, batch_id: int, deal: str | None) -> None:
    rows = conform(df, LOG_SCHEMA, "log rows").withColumn(LOG_PARTITION, F.to_date("ts"))
    _check_layout(df.sparkSession, path)
    if deal == "range":
        rows = rows.repartitionByRange(LOG_PARTITION, "ts", "line_id")
    elif deal == "rebalance":
        rows = rows.hint("rebalance", LOG_PARTITION)
    rows = rows.withColumns({WRITER_PARTITION: F.lit(writer), BATCH_PARTITION: F.lit(batch_id)})
    if deal == "range":
        rows = rows.sortWithinPartitions(*PARTITIONS, "ts", "line_id")
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


# ---------------------------------------------------------------- the index
def index_batches(spark: SparkSession, path: str, folders: list[str]) -> int:
    """Write the index of batch folders (names below ``path``) that have none; how many.

    One job reads the ``ts`` of those folders alone, counted per file by a partial
    aggregation. The index of a folder appears in it by one rename, whole or
    not at all. A folder that is missing, or gone meanwhile, is passed over.
    """
    fs, _ = _fs(spark, path)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    todo = [
        f for f in folders
        if fs.exists(path_of(f"{path}/{f}")) and not fs.exists(path_of(f"{path}/{f}/{INDEX}"))
    ]
    if not todo:
        return 0
    stored = spark.read.schema(as_struct(STORED_SCHEMA)).option("basePath", path)
    ranges = (
        stored.parquet(*[f"{path}/{f}" for f in todo])
        .select(*PARTITIONS, F.col("_metadata.file_name").alias("file"), "ts")
        .groupBy(*PARTITIONS, "file")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    )
    staged = f"{path}/{INDEX}-{uuid.uuid4().hex}"
    # the ranges of a batch in one file, and few files in a task
    ranges.hint("rebalance", *PARTITIONS).write.partitionBy(*PARTITIONS).parquet(staged)
    done = 0
    for f in todo:
        if fs.exists(path_of(f"{staged}/{f}")):
            done += fs.rename(path_of(f"{staged}/{f}"), path_of(f"{path}/{f}/{INDEX}"))
    fs.delete(path_of(staged), True)
    return done


def _batches(
    spark: SparkSession, path: str, day: str, writer: str = f"{WRITER_PARTITION}=*"
) -> tuple[list[str], list[str]]:
    """Batch folders, named below ``path``, with and without an index, of a day and
    writer folder, either of which may be a pattern."""
    pattern = f"{path}/{day}/{writer}/{BATCH_PARTITION}=*"
    fs, every = _fs(spark, pattern)
    index = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{pattern}/{INDEX}")
    own = {_below(s.getPath(), 3) for s in fs.globStatus(every) or []}
    indexed = {_below(s.getPath().getParent(), 3) for s in fs.globStatus(index) or []}
    return sorted(indexed), sorted(own - indexed)


def _below(path, levels: int) -> str:
    """The last names of a path."""
    return "/".join(path.toString().rsplit("/", levels)[1:])


# ---------------------------------------------------------------- reading
def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored log with the partition columns.

    The schema is the declared one, so no footer is opened to find it.
    """
    return _read_stored(spark, path, [path] if log_days(spark, path) else [])


def _read_stored(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """Folders or files of the log at ``path``."""
    if not parts:
        return spark.createDataFrame([], STORED_SCHEMA)
    return spark.read.schema(as_struct(STORED_SCHEMA)).option("basePath", path).parquet(*parts)


def _log_columns(stored: DataFrame) -> DataFrame:
    return stored.drop(*PARTITIONS)


def _moment(text: str | dt.datetime, name: str) -> Column:
    """A bound as ``timestamp_ntz``; anything but a time without zone raises."""
    try:
        t = text if isinstance(text, dt.datetime) else dt.datetime.fromisoformat(text.strip())
    except (ValueError, AttributeError) as e:
        raise ValueError(f"{name} is not a time: {text!r}") from e
    if t.tzinfo is not None:
        raise ValueError(f"{name} must have no time zone: {text!r}")
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def read_log(
    spark: SparkSession,
    path: str,
    since: str | dt.datetime | None = None,
    until: str | dt.datetime | None = None,
) -> DataFrame:
    """The five log columns; no rows if nothing has been written yet.

    ``since`` (inclusive) and ``until`` (exclusive) bound ``ts``, given as
    text such as ``"2024-01-30 12:00:00"`` (read as timestamp_ntz, so no
    time zone applies). Both the day folders (partition pruning) and the
    row groups (pushed ``ts`` filter) outside the range are skipped.
    """
    lo = None if since is None else _moment(since, "since")
    hi = None if until is None else _moment(until, "until")
    stored = _stored(spark, path)
    if lo is not None:
        stored = stored.filter((F.col(LOG_PARTITION) >= F.to_date(lo)) & (F.col("ts") >= lo))
    if hi is not None:
        stored = stored.filter((F.col(LOG_PARTITION) <= F.to_date(hi)) & (F.col("ts") < hi))
    return _log_columns(stored)


def log_tail(log: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows of any log DataFrame.

    Planned as ``TakeOrderedAndProject``: each task keeps its own top ``n``
    and only those reach the final merge, so there is no full sort.
    """
    if n < 0:
        raise ValueError("n must be >= 0")
    return log.orderBy(*_newest_first()).limit(n)


def _newest_files(ranges: DataFrame, n: int) -> tuple[int, object]:
    """(rows, bound): files of the greatest ``lo`` that together hold ``n`` rows, and
    the least ``lo`` of them; all rows and no bound if the files hold fewer.

    A file has a row at least, so the first ``n`` files do; they are asked for in
    growing numbers.
    """
    k = 64
    while True:
        first = ranges.orderBy(F.col("lo").desc()).limit(min(k, n)).collect()
        held = 0
        for r in first:
            held += r["rows"]
            if held >= n:
                return held, r["lo"]
        if len(first) < min(k, n) or k >= n:
            return held, None
        k *= 4


def tail_files(spark: SparkSession, path: str, n: int) -> tuple[list[str], dt.datetime | None]:
    """Files and batch folders that hold the newest ``n`` rows, and a bound that those
    rows' ``ts`` are not below, or None.

    Days are taken from the newest back until ``n`` rows are held; no older one is
    opened. In the last of them, with ``n`` rows in files that begin at a bound
    or above it, every file that ends below the bound is left closed. Batches
    without an index are taken whole, and counted from their footers only where the
    indexed files hold too few rows.
    """
    taken: list[str] = []
    held = 0
    for day in log_days(spark, path):
        if held >= n:
            break
        indexed, plain = _batches(spark, path, day)
        taken += [f"{path}/{f}" for f in plain]
        bound = None
        if indexed:
            ranges = (
                spark.read.schema(f"{INDEX_SCHEMA}, {WRITER_PARTITION} string, {BATCH_PARTITION} bigint")
                .option("basePath", f"{path}/{day}")
                .parquet(*[f"{path}/{f}/{INDEX}" for f in indexed])
            )
            if not day.endswith(NO_DAY):
                rows, bound = _newest_files(ranges, n - held)
                held += rows
            near = ranges if bound is None else ranges.where(F.col("hi") >= F.lit(bound).cast("timestamp_ntz"))
            taken += [
                f"{path}/{day}/{WRITER_PARTITION}={r[0]}/{BATCH_PARTITION}={r[1]}/{r[2]}"
                for r in near.select(WRITER_PARTITION, BATCH_PARTITION, "file").collect()
            ]
        if bound is not None:
            return taken, bound
        if plain and held < n:
            held += _read_stored(spark, path, [f"{path}/{f}" for f in plain]).count()
    return taken, None


def read_log_tail(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The newest ``n`` rows of the stored log at ``path``.

    Every row of an older day is older than each row of a newer one, and rows
    without a time are oldest. The top ``n`` runs over the newest files only
    (:func:`tail_files`), with the bound pushed into their scan.
    """
    if n < 0:
        raise ValueError("n must be >= 0")
    files, bound = tail_files(spark, path, n) if n else ([], None)
    stored = _read_stored(spark, path, files)
    if bound is not None:
        stored = stored.where(F.col("ts") >= F.lit(bound).cast("timestamp_ntz"))
    return log_tail(_log_columns(stored), n)


# ---------------------------------------------------------------- compaction
def compact_day(spark: SparkSession, path: str, day: str | None) -> int:
    """Rewrite one day's finished batches into few files; how many were merged.

    ``day`` is ``yyyy-mm-dd``, or None for rows without a time. The newest batch
    of every writer stays as it is, because a stream may run that one again;
    earlier batches are final. Their rows become one batch of a new writer, in
    ranges of (``ts``, ``line_id``) with an index; batches that stay are indexed too.

    Run it while nobody reads or writes that day. The new files are staged in a
    hidden folder first, and a list of what they replace is written last; a call
    that was interrupted after that is finished by the next one.
    """
    folder = f"{LOG_PARTITION}={day or NO_DAY}"
    _finish_compaction(spark, path)
    if folder not in log_days(spark, path):
        return 0
    newest: dict[str, int] = {}
    for d in log_days(spark, path):
        for w in _folders(spark, f"{path}/{d}"):
            ids = [int(b.split("=", 1)[1]) for b in _folders(spark, f"{path}/{d}/{w}")]
            newest[w] = max([newest.get(w, -1), *ids])
    merged = [
        f"{folder}/{w}/{b}"
        for w in _folders(spark, f"{path}/{folder}")
        for b in _folders(spark, f"{path}/{folder}/{w}")
        if int(b.split("=", 1)[1]) < newest[w] or _is_append(w)
    ]
    if len(merged) < 2:
        index_batches(spark, path, _batches(spark, path, folder)[1])
        return 0
    rows = (
        spark.read.schema(as_struct(STORED_SCHEMA)).option("basePath", path)
        .parquet(*[f"{path}/{m}" for m in merged])
    )
    writer = f"{WRITER_PARTITION}={ANONYMOUS}compact-{uuid.uuid4().hex}"
    target = f"{folder}/{writer}/{BATCH_PARTITION}=0"
    staged = f"{path}/{STAGING}/data"
    ranged = _log_columns(rows).repartitionByRange("ts", "line_id").sortWithinPartitions("ts", "line_id")
    ranged.write.mode("overwrite").parquet(staged)
    plan = spark.createDataFrame([(target, m) for m in merged], "target string, old string")
    plan.coalesce(1).write.mode("overwrite").parquet(f"{path}/{STAGING}/plan")
    _finish_compaction(spark, path)
    index_batches(spark, path, _batches(spark, path, folder)[1])
    return len(merged)


def _is_append(writer: str) -> bool:
    """Whether a writer is an append without an id of its own, which never runs again."""
    return writer.startswith(f"{WRITER_PARTITION}={ANONYMOUS}")


def _finish_compaction(spark: SparkSession, path: str) -> None:
    """Carry out a staged compaction, from wherever it stopped."""
    fs, done = _fs(spark, f"{path}/{STAGING}/plan/_SUCCESS")
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if fs.exists(done):
        plan = spark.read.parquet(f"{path}/{STAGING}/plan").collect()  # one row per batch folder
        for r in plan:
            fs.delete(path_of(f"{path}/{r['old']}"), True)
        target, staged = path_of(f"{path}/{plan[0]['target']}"), path_of(f"{path}/{STAGING}/data")
        if fs.exists(staged):
            fs.mkdirs(target.getParent())
            if not fs.rename(staged, target):
                raise OSError(f"could not move the compacted files to {target}")
    fs.delete(path_of(f"{path}/{STAGING}"), True)
