"""Structured Streaming variants: ingest, live bins, live sessions, periodic refresh.

Two kinds. Exact tables: ``ingest_into_store`` merges every batch into the store; ``write_bins`` and ``write_sessions`` write what each
batch adds, counts per (bin, user) and per (user, cell), and reading puts the parts together. They keep no state, so a row counts however
late it comes and open sessions are there too; a batch that is repeated replaces its own part. A message that is sent twice counts twice
in bins and sessions: read them from the store, or stream ``deduplicated`` rows, where that can happen.

Windowed tables with state (``live_bins``, ``live_sessions``), written when the watermark closes them. Late rows are accepted for ten minutes, the overlap with which the live month
is topped up in batch. Of two copies of a message the stream keeps the first
and the batch merge the last; logged messages do not change, so both agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from parley import constants as C
from parley.functions import text as tx
from parley.functions.core import time_cell
from parley.operators.sessions import joined_cells, session_cells
from parley.sources import store
from parley.sources.records import normalize_messages, parse_records

#: Merges into the store that are tried where another writer comes first.
MERGE_TRIES = 5
LATENESS = f"{C.REFRESH_OVERLAP_MINUTES} minutes"


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw records arriving as JSON-lines files, as messages."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return normalize_messages(parse_records(reader.text(path)))


def _timed(messages: DataFrame) -> DataFrame:
    """Watermarks need an instant; the session time zone is UTC, so this changes the type only.

    A stream whose ``ts`` is an instant already carries its watermark and keeps it.
    """
    if dict(messages.dtypes)["ts"] == "timestamp":
        return messages
    return messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)


def deduplicated(messages: DataFrame) -> DataFrame:
    """One row per message id; state is kept for the lateness only. Rows without id all pass."""
    timed = _timed(messages)
    named = timed.filter(F.col("id").isNotNull()).dropDuplicatesWithinWatermark(["id"])
    return named.unionByName(timed.filter(F.col("id").isNull()))


def ingest_stream(messages: DataFrame, id_type: str = "channel") -> DataFrame:
    """Deduplicated messages with the partition columns of the store."""
    rows = deduplicated(messages).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return rows.withColumn("channel_key", tx.channel_key("channel", id_type)).withColumn(
        "year_month", F.date_format("ts", "yyyy_MM")
    )


def live_bins(messages: DataFrame) -> DataFrame:
    """Messages per 5-minute bin, and users per bin as an estimate: a stream has no exact distinct count."""
    bins = _timed(messages).groupBy(F.window("ts", f"{C.BIN_MINUTES} minutes").alias("w"))
    return bins.agg(
        F.count("*").alias("message_count"), F.approx_count_distinct("user_id", 0.02).alias("unique_chatters")
    ).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "message_count", "unique_chatters")


def live_sessions(messages: DataFrame, gap_minutes: int = 15) -> DataFrame:
    """Sessions per user. A pause of exactly the gap still joins here, while the batch table splits it."""
    windows = F.session_window("ts", f"{gap_minutes} minutes").alias("w")
    sessions = _timed(messages).groupBy("user_id", windows).agg(
        F.count("*").alias("messages"), F.min("ts").alias("session_start"), F.max("ts").alias("session_end")
    )
    ends = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")]
    return sessions.select("user_id", *ends, "messages")


def write_stream(table: DataFrame, path: str, checkpoint: str, partitions=(), every: str | None = None) -> StreamingQuery:
    """Append a streaming table to Parquet: all there is now, or again and again after ``every``."""
    writer = table.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start(path)


def write_windows(table: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write the windows that each batch touched, with their figures so far, in a folder of its own below ``path``.

    So windows that are still open are there too; a batch that is repeated after a failure replaces its own folder.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = table.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def read_windows(spark: SparkSession, path: str, table: DataFrame, key: str = "window_start") -> DataFrame:
    """The latest figures of each window that ``write_windows`` has written for a streaming table."""
    shape = T.StructType([*table.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(shape).parquet(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in table.columns if c != key)), "batch").alias("w")).select(key, "w.*")


def _each_batch(table: DataFrame, checkpoint: str, keep: Callable[[DataFrame, int], None], every: str | None) -> StreamingQuery:
    writer = table.writeStream.option("checkpointLocation", checkpoint).foreachBatch(keep)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ingest_into_store(
    messages: DataFrame,
    root: str,
    checkpoint: str,
    id_type: str = "channel",
    arrival: str | None = None,
    stage: str | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Merge every batch into the store. Rows of any age are taken, and of repeated ids the last to come stays.

    The store notes the last batch of each checkpoint in the commit that holds its rows, so a batch that is run again after a failure
    changes nothing. A checkpoint folder that is emptied and used again would be taken for the old one: give it another name.
    """

    def keep(batch: DataFrame, number: int) -> None:
        for left in reversed(range(MERGE_TRIES)):
            try:
                store.merge_store(batch.sparkSession, root, batch, id_type, arrival, stage, (checkpoint, number))
                return
            except store.MergeConflict:
                if not left:
                    raise

    return _each_batch(messages, checkpoint, keep, every)


def write_parts(
    messages: DataFrame, part: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Write what each batch adds to a table, in a folder of its own below ``path``."""

    def keep(batch: DataFrame, number: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark = messages.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return _each_batch(messages, checkpoint, keep, every)


def write_bins(messages: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Messages per 5-minute bin and user, as each batch adds them; ``read_bins`` sums them up."""
    start = time_cell("ts", f"{C.BIN_MINUTES} minutes").alias("window_start")
    return write_parts(messages, lambda batch: batch.groupBy(start, "user_id").agg(F.count("*").alias("n")), path, checkpoint, every)


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """Messages and users of every bin so far, exact."""
    parts = spark.read.schema("window_start timestamp_ntz, user_id string, n long").parquet(path)
    users = parts.groupBy("window_start", "user_id").agg(F.sum("n").alias("n"))
    return users.groupBy("window_start").agg(F.sum("n").alias("message_count"), F.count("user_id").alias("unique_chatters"))


def write_sessions(
    messages: DataFrame, path: str, checkpoint: str, gap_minutes: int = 15, every: str | None = None
) -> StreamingQuery:
    """Cells of one gap's length per user, as each batch adds them; ``read_sessions`` joins neighbours."""
    return write_parts(messages, lambda batch: session_cells(batch, gap_minutes), path, checkpoint, every)


def read_sessions(spark: SparkSession, path: str, gap_minutes: int = 15) -> DataFrame:
    """All sessions so far, open ones included, as ``sessions.session_table`` has them; the gap is that of the writer."""
    shape = "user_id string, cell timestamp_ntz, n long, start timestamp_ntz, end timestamp_ntz"
    parts = spark.read.schema(shape).parquet(path)
    cells = parts.groupBy("user_id", "cell").agg(F.sum("n").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
    return joined_cells(cells, gap_minutes)


def live_refresh(table: DataFrame, path: str, checkpoint: str, partitions=()) -> StreamingQuery:
    """Keep a live table no older than 15 minutes."""
    return write_stream(table, path, checkpoint, partitions, every=f"{C.LIVE_TTL_S // 60} minutes")
