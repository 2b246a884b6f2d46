"""O8: answer command lines as they arrive.

Lines are read with Structured Streaming from a folder of Parquet files.
Each micro-batch goes through the same ``dispatch_commands`` as a batch
job, inside ``foreachBatch``. That keeps one code path for O5 and O8 and
lets each micro-batch be planned as an ordinary batch query with AQE on
(Spark turns it off for plain streaming plans).

The lookups are not aggregated in every micro-batch. Their answers are a written
table beside the checkpoint (``AnswerTable``), made when the stream starts and again
only when the lookups change; a restart finds it there. If its measured size
allows, every micro-batch joins it by broadcast. Otherwise a micro-batch is small
next to the answers, so it uses ``keys``: its distinct keys (count checked) prune
the scan of the sorted table and the answers come back by broadcast. A plain
stream-static join would instead shuffle the whole lookup side in every
micro-batch. A batch that asks for too many keys falls back to the plain join.
Rows and errors are the same either way. The catalogue is checked once. The
batch is kept (memory and disk) while it is answered, so reading it twice does
not read its files twice.

Exactly-once output: the output folder is a reply log, and micro-batch ``b`` of
this stream is the batch ``(stream id, b)`` in it, written with dynamic
partition overwrite. A batch re-run after a failure replaces exactly its own
folders, and the checkpoint keeps finished batches from running again. The
stream id comes from the checkpoint, so another stream with a checkpoint of its
own adds to the same log and replaces nothing. The log readers (``read_log``,
``read_log_tail``) work on it.

``stream_append`` is the plain form: one streaming plan, a stream-static join with the
answers, into Spark's own file sink, whose commit log makes it exactly-once. It
writes a folder of its own (no log, no compaction) and sees the lookups as they
were when it started.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from parlance.operators.answers import Answers, AnswerTable, lookup_version
from parlance.operators.dispatch import (
    LOOKUP_BROADCAST_MAX_BYTES,
    LOOKUP_BROADCAST_MAX_ROWS,
    Catalogue,
    catalogue_side,
    check_lookups,
    dispatch_commands,
    observe_statuses,
)
from parlance.operators.log import LOG_PARTITION, LOG_SCHEMA, log_write_batch, read_log

LINE_SCHEMA = "line_id bigint, ts timestamp_ntz, line string"


def stream_dispatch(
    spark: SparkSession,
    in_dir: str | DataFrame,
    out_dir: str,
    ckpt: str,
    catalogue: Catalogue | DataFrame,
    lookups: DataFrame | Callable[[], DataFrame],
    *,
    available_now: bool = True,
    processing_time: str | None = None,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: str | int | None = None,
    strategy: str | None = None,
    check_unique: bool = True,
    broadcast_max_rows: int = LOOKUP_BROADCAST_MAX_ROWS,
    broadcast_max_bytes: int = LOOKUP_BROADCAST_MAX_BYTES,
) -> StreamingQuery:
    """Start the stream; returns the running ``StreamingQuery``.

    ``in_dir`` is a folder of Parquet files of ``LINE_SCHEMA``, or any
    streaming DataFrame with those columns (a Kafka source after parsing
    its value, say); the ``max_*_per_trigger`` options apply to the folder.
    ``available_now`` processes what is there and stops (for tests and
    scheduled runs); otherwise ``processing_time`` sets the trigger.
    ``lookups`` may be a function returning a DataFrame; it is then called
    for every micro-batch, so lookup files added while the stream runs are
    seen (a DataFrame's file listing is fixed when it is made).

    The answers are kept in ``<ckpt>-answers`` and rewritten when the version of the
    lookups changes (their query, or path, length or time of a file). Lookups
    that are not read from files have no version: a DataFrame of them is
    aggregated once a start, and a function's in every batch, unwritten.

    ``strategy=None`` picks ``auto`` or ``keys`` from the exact size of the answers
    against ``broadcast_max_rows`` and ``broadcast_max_bytes``, once a version.
    Any strategy of ``dispatch_commands`` may be forced instead. ``check_unique``
    works as there: a line that asks for a repeated key fails its batch.
    """
    fresh = callable(lookups)
    table = AnswerTable(spark, _answers_dir(ckpt))
    fixed = None if fresh else table.current(lookups)
    cat = catalogue_side(spark, catalogue)
    lines = _lines(spark, in_dir, max_files_per_trigger, max_bytes_per_trigger)
    out = out_dir.rstrip("/")

    ids: list[str] = []

    def stream_id() -> str:
        """The id Spark keeps in the checkpoint; the same after every restart."""
        if not ids:
            text = spark.read.text(f"{ckpt.rstrip('/')}/metadata", wholetext=True).first()[0]
            ids.append(f"stream-{json.loads(text)['id']}")
        return ids[0]

    def answer_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            look = fixed or _latest(table, lookups())
            use = strategy
            if use is None:
                if isinstance(look, Answers):
                    fits = look.fits(broadcast_max_rows, broadcast_max_bytes)
                else:
                    fits = check_lookups(look, broadcast_max_rows, broadcast_max_bytes, unique=False).fits
                use = "auto" if fits else "keys"
            replies = dispatch_commands(batch, cat, look, strategy=use, check_unique=check_unique)
            log_write_batch(replies, out, stream_id(), batch_id)
        finally:
            batch.unpersist()

    writer = lines.writeStream.foreachBatch(answer_batch).option("checkpointLocation", ckpt)
    return _triggered(writer, available_now, processing_time).start()


def _answers_dir(ckpt: str) -> str:
    return f"{ckpt.rstrip('/')}-answers"


def _latest(table: AnswerTable, lookups: DataFrame) -> Answers | DataFrame:
    """The kept answers, or the lookups themselves where no version can be told."""
    version = lookup_version(lookups)
    return table.current(lookups, version) if version else lookups


def _lines(
    spark: SparkSession,
    in_dir: str | DataFrame,
    max_files_per_trigger: int | None,
    max_bytes_per_trigger: str | int | None,
) -> DataFrame:
    if isinstance(in_dir, DataFrame):
        if not in_dir.isStreaming:
            raise ValueError("give a streaming DataFrame or a folder")
        return in_dir.select("line_id", "ts", "line")
    reader = spark.readStream.schema(LINE_SCHEMA)
    # Bounding a micro-batch (by files or bytes) bounds the keys it asks
    # for, which keeps batches on the ``keys`` path.
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    return reader.parquet(in_dir)


def _triggered(
    writer: DataStreamWriter, available_now: bool, processing_time: str | None
) -> DataStreamWriter:
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=processing_time) if processing_time else writer


# Name of the counts per status in the progress of ``stream_append``.
STATUS_COUNTS = "statuses"


def stream_append(
    spark: SparkSession,
    in_dir: str | DataFrame,
    out_dir: str,
    ckpt: str,
    catalogue: Catalogue | DataFrame,
    lookups: DataFrame,
    *,
    available_now: bool = True,
    processing_time: str | None = None,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: str | int | None = None,
    check_unique: bool = True,
) -> StreamingQuery:
    """Answer lines through Spark's file sink, in append mode, by one streaming plan.

    The lines are parsed and joined to the catalogue and to the kept answers
    (``<ckpt>-answers``, aggregated once a version) by a stream-static join: by broadcast
    where their measured size allows, else each micro-batch shuffles them. There is no
    state and no watermark. Files go to ``out_dir`` by day of ``ts``; the sink's commit
    log names the files of finished batches, and :func:`read_appended` reads
    only those, so a restart or a batch that ran twice adds no row. Lines per
    status are in the query's progress, under ``observedMetrics["statuses"]``.
    """
    answers = AnswerTable(spark, _answers_dir(ckpt)).current(lookups)
    lines = _lines(spark, in_dir, max_files_per_trigger, max_bytes_per_trigger)
    replies = dispatch_commands(lines, catalogue, answers, check_unique=check_unique)
    replies = observe_statuses(replies, STATUS_COUNTS).withColumn(LOG_PARTITION, F.to_date("ts"))
    writer = (
        replies.writeStream.format("parquet").outputMode("append").partitionBy(LOG_PARTITION)
        .option("checkpointLocation", ckpt).option("path", out_dir)
    )
    return _triggered(writer, available_now, processing_time).start()


def read_appended(spark: SparkSession, out_dir: str) -> DataFrame:
    """What ``stream_append`` has finished: the five log columns; no rows before that."""
    sc = spark.sparkContext
    done = sc._jvm.org.apache.hadoop.fs.Path(f"{out_dir.rstrip('/')}/_spark_metadata")
    if not done.getFileSystem(sc._jsc.hadoopConfiguration()).exists(done):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(f"{LOG_SCHEMA}, {LOG_PARTITION} date").parquet(out_dir).drop(LOG_PARTITION)


def read_stream_output(spark: SparkSession, out_dir: str) -> DataFrame:
    """The replies written so far, as ``(line_id, ts, verb, status, reply)``;
    no rows while nothing has been answered."""
    return read_log(spark, out_dir)
