"""The message store: Parquet by channel key and month, in versions.

A merge writes whole months into a folder of its own, ``data/merge=.../channel_key=.../year_month=...``, and next to them the number
of messages of every minute. A manifest names, for each month, the merge whose files hold it; a commit names the manifest and is put in
place by a rename that fails if the version exists. So a reader has the months of one version, whatever is written meanwhile, a merge
that dies leaves files that no manifest names, and of two merges at once the second is refused.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text as tx
from parley.functions.core import time_cell
from parley.operators.filters import slice_window
from parley.schema import MESSAGES
from parley.session import shared_folder
from parley.sources.records import superseded

VERSION = "v2"
PARTITIONS = ("channel_key", "year_month")
#: How Spark names the folder of a null.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
STORED = T.StructType([*MESSAGES.fields, *[T.StructField(c, T.StringType()) for c in PARTITIONS]])
MINUTES = "minute timestamp_ntz, messages long, channel_key string, year_month string"
MANIFEST = "channel_key string, year_month string, merge string"
#: Rows of the files that a merge copies at once: their bits, at most 1 / 64 as many rows, are broadcast. Bytes that a task copies, about.
COPIED_ROWS, COPIED_BYTES = 1 << 25, 16 << 20


class MergeConflict(RuntimeError):
    """Another merge was committed since this one began; nothing of this one is visible. Merge again."""


@dataclass(frozen=True)
class Snapshot:
    """One version of a store: its manifest and, per stream, the last batch that was merged."""

    version: int
    manifest: str
    batches: dict[str, int] = field(default_factory=dict)


def location(root: str) -> str:
    """Stores of another schema version live beside this one and are never mixed with it."""
    return f"{root.rstrip('/')}/{VERSION}"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, oldest first."""
    path, files = _path(spark, f"{location(root)}/commits")
    names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    return sorted(int(n) for n in names if n.isdigit())


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot | None:
    """The newest version, or a given one that is still kept; None before the first merge."""
    if version is None:
        found = versions(spark, root)
        if not found:
            return None
        version = found[-1]
    shape = "manifest string, batches map<string,bigint>"
    row = spark.read.schema(shape).json(f"{location(root)}/commits/{version:020d}").first()
    return Snapshot(version, row["manifest"], dict(row["batches"] or {}))


def _commit(spark: SparkSession, root: str, new: Snapshot) -> None:
    folder = f"{location(root)}/commits"
    path, files = _path(spark, folder)
    files.mkdirs(path)
    batches = F.create_map(*(F.lit(x) for pair in new.batches.items() for x in pair)) if new.batches else F.lit(None).cast("map<string,bigint>")
    line = spark.range(1).select(F.to_json(F.struct(F.lit(new.manifest).alias("manifest"), batches.alias("batches")))).first()[0]
    part, _ = _path(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = files.create(part, False)
    out.write(bytearray(line.encode()))
    out.close()
    target, _ = _path(spark, f"{folder}/{new.version:020d}")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(part, target, options)
    except Py4JJavaError as e:
        files.delete(part, False)
        if "FileAlreadyExistsException" in e.java_exception.toString():
            raise MergeConflict(f"version {new.version} of {root} exists") from e
        raise


def manifest(spark: SparkSession, root: str, at: Snapshot) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{location(root)}/manifests/{at.manifest}")


def _folders(spark: SparkSession, root: str, at: Snapshot, kind: str, where: Column | None) -> list[str]:
    """The folders of the months that ``where`` names: as many as a scan of them lists."""
    rows = manifest(spark, root, at)
    names = [F.coalesce(c, F.lit(NULL_FOLDER)) for c in PARTITIONS]
    found = (rows if where is None else rows.filter(where)).select(*names, "merge").collect()
    return [f"{location(root)}/{kind}/merge={m}/channel_key={c}/year_month={y}" for c, y, m in sorted(found)]


def _read(spark: SparkSession, root: str, at: Snapshot, kind: str, schema, where: Column | None) -> DataFrame:
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    folders = _folders(spark, root, at, kind, where)
    if not folders:
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema.fields, T.StructField("merge", T.StringType())])
    rows = spark.read.schema(whole).option("basePath", f"{location(root)}/{kind}").parquet(*folders).drop("merge")
    return rows if where is None else rows.filter(where)


def _with_partitions(df: DataFrame, id_type: str) -> DataFrame:
    return df.withColumn("channel_key", tx.channel_key("channel", id_type)).withColumn(
        "year_month", F.date_format("ts", "yyyy_MM")
    )


def scan(spark: SparkSession, root: str, at: Snapshot | None = None, where: Column | None = None) -> DataFrame | None:
    """The whole store, or the months that a condition on ``PARTITIONS`` names; None before the first merge."""
    at = at or snapshot(spark, root)
    return at and _read(spark, root, at, "data", STORED, where)


def _touched(channels, start, end, id_type: str) -> Column:
    names = [channels] if isinstance(channels, str) else list(channels)
    wanted = [tx.channel_key(F.lit(n), id_type) for n in names]
    low, high = str(start)[:7].replace("-", "_"), str(end)[:7].replace("-", "_")
    return F.col("channel_key").isin(*wanted) & F.col("year_month").between(low, high)


def read_store(
    spark: SparkSession, root: str, channels, start, end, id_type: str = "channel", at: Snapshot | None = None
) -> DataFrame:
    """Messages of some channels in [start, end): only the months touched are listed and read."""
    stored = scan(spark, root, at, _touched(channels, start, end, id_type))
    if stored is None:
        return spark.createDataFrame([], MESSAGES)
    return slice_window(stored, start, end)


def minutes(spark: SparkSession, root: str, channels, id_type: str = "channel", at: Snapshot | None = None) -> DataFrame:
    """Messages per channel and minute, as the merges counted them."""
    at = at or snapshot(spark, root)
    if at is None:
        return spark.createDataFrame([], MINUTES)
    return _read(spark, root, at, "minutes", MINUTES, _touched(channels, "0000-00", "9999-99", id_type))


def _months(found: list) -> Column:
    """Some partitions as a filter: one test per channel, over its months."""
    tests = [F.col("channel_key").eqNullSafe(c) & (F.col("year_month").isin(*m) | (F.lit(n) & F.col("year_month").isNull())) for c, m, n in found]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def merge_store(
    spark: SparkSession,
    root: str,
    new: DataFrame,
    id_type: str = "channel",
    arrival: str | None = None,
    stage: str | None = None,
    batch: tuple[str, int] | None = None,
) -> bool:
    """Add messages to the months they fall in; a message already there is replaced by the new one.

    Of several new copies of one id the last arrived stays: ``arrival`` names the column that orders them. Without it the copy with the
    greatest time stays, and of equal times the one whose text has the greatest hash, so the outcome never depends on the order of rows.
    The new rows are staged by month; only the months found there are read. Which rows of these files go is found by ids and places of
    rows in files, without the texts; all other rows are then copied, file by file, and not shuffled. ``stage`` is a folder that all
    executors share (by default one below spark.checkpoint.dir); what is staged there is removed at the end. A task copies some files
    of about ``COPIED_BYTES`` together, so a large month has many files and small files of a month become few. Merging the same messages
    twice changes nothing. ``batch`` is the name of a stream and the number of its batch: one that was merged before is left alone (False).
    ``MergeConflict`` is raised if another merge was committed meanwhile.
    """
    now = snapshot(spark, root)
    if batch and now and now.batches.get(batch[0], -1) >= batch[1]:
        return False
    folder = f"{(stage or shared_folder(spark)).rstrip('/')}/parley-stage-{uuid.uuid4().hex}"
    came = F.lit(0) if arrival is None else F.col(arrival)
    fresh = _with_partitions(new.select(*MESSAGES.fieldNames(), came.alias("__came")), id_type)
    order = [F.col("__came"), F.col("ts"), tx.text_key("text")]
    try:
        _write(fresh, f"{folder}/new")
        fresh = spark.read.schema(fresh.schema).parquet(f"{folder}/new")
        months = fresh.groupBy("channel_key").agg(F.collect_set("year_month"), F.bool_or(F.col("year_month").isNull())).collect()
        merge = uuid.uuid4().hex
        if months:
            places = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"), F.col("_metadata.file_size").alias("__size")]
            every = fresh.select("*", *places, F.lit(1).alias("__new"))
            if now is not None and _folders(spark, root, now, "data", _months(months)):
                none = F.lit(None).cast(fresh.schema["__came"].dataType)
                kept = scan(spark, root, now, _months(months)).select("*", *places, F.lit(0).alias("__new"), none.alias("__came"))
                every = kept.select(*every.columns).unionByName(every)
            _copy(spark, every, [F.col("__new"), *order], f"{folder}/lost", f"{location(root)}/data/merge={merge}")
            whole = spark.read.schema(STORED).parquet(f"{location(root)}/data/merge={merge}")
            counted = whole.groupBy(*PARTITIONS, time_cell("ts", "1 minute").alias("minute")).agg(F.count("*").alias("messages"))
            _write(counted.hint("rebalance", *PARTITIONS), f"{location(root)}/minutes/merge={merge}")
        here = fresh.select(*PARTITIONS).distinct().withColumn("merge", F.lit(merge))
        if now is not None:
            here = manifest(spark, root, now).filter(~F.coalesce(_months(months), F.lit(False))).unionByName(here)
        here.hint("rebalance").write.parquet(f"{location(root)}/manifests/{merge}")
    finally:
        path, files = _path(spark, folder)
        files.delete(path, True)
    before = now or Snapshot(0, "")
    _commit(spark, root, Snapshot(before.version + 1, merge, before.batches | dict([batch] if batch else [])))
    return True


def _copy(spark: SparkSession, every: DataFrame, order: list[Column], stage: str, path: str) -> None:
    """Write the rows of some files (``__file``, ``__row``, ``__size``) to ``path``, of each id the last in ``order``."""
    name = F.xxhash64("__file")
    found = every.groupBy("__file", "__size").agg(F.count("*").alias("rows")).withColumn("name", name).collect()
    if len({f["name"] for f in found}) < len(found):
        raise RuntimeError("two files have one hash; merge again")
    superseded(every, order, "__file", "__row").select(name.alias("__name"), "__word", "__lost").write.parquet(stage)
    lost = spark.read.schema("__name bigint, __word bigint, __lost bigint").parquet(stage)
    rows = every.withColumn("__name", name).withColumn("__word", F.shiftright("__row", 6))
    bit = F.expr("shiftleft(1L, cast(__row & 63 as int))")
    gone = F.coalesce(F.col("__lost").bitwiseAND(bit) != 0, F.lit(False))
    for part in _parts(sorted(found, key=lambda f: f["name"])):
        here = F.col("__name").between(part[0]["name"], part[-1]["name"])
        kept = rows.filter(here).join(F.broadcast(lost.filter(here)), ["__name", "__word"], "left").filter(~gone)
        tasks = -(-sum(f["__size"] for f in part) // COPIED_BYTES)
        _write(kept.select(*STORED.fieldNames()).coalesce(max(1, tasks)), path, "append")


def _parts(files: list) -> list[list]:
    """Files in runs of ``COPIED_ROWS`` rows, or of one file that has more."""
    out, held = [], 0
    for file in files:
        if not out or held + file["rows"] > COPIED_ROWS:
            out.append([])
            held = 0
        out[-1].append(file)
        held += file["rows"]
    return out


def _write(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).option("compression", "zstd").partitionBy(*PARTITIONS).parquet(path)


def vacuum(spark: SparkSession, root: str, keep: int = 10) -> int:
    """Remove commits before the last ``keep`` and the months that only they name; returns how many months. Readers of those versions fail."""
    found = versions(spark, root)
    old, kept = found[:-keep], found[-keep:]
    if not old or not kept:
        return 0
    rows = lambda numbers: reduce(DataFrame.unionByName, (manifest(spark, root, snapshot(spark, root, v)) for v in numbers)).distinct()
    names = [F.coalesce(c, F.lit(NULL_FOLDER)).alias(c) for c in (*PARTITIONS, "merge")]
    gone = rows(old).select(*names).exceptAll(rows(kept).select(*names)).collect()
    for c, y, m in gone:
        for kind in ("data", "minutes"):
            path, files = _path(spark, f"{location(root)}/{kind}/merge={m}/channel_key={c}/year_month={y}")
            files.delete(path, True)
    for v in old:
        for name in (f"manifests/{snapshot(spark, root, v).manifest}", f"commits/{v:020d}"):
            path, files = _path(spark, f"{location(root)}/{name}")
            files.delete(path, True)
    return len(gone)
