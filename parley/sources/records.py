"""Raw log records and the messages table made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.functions.core import keys
from parley.schema import MESSAGES, RAW, RAW_ENVELOPE, RAW_OR_CORRUPT

#: Bits of the filter of repeated ids: its size does not depend on the data.
REPEAT_BITS = 1 << 24


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Raw records of files with one per line, and in ``_corrupt_record`` the lines that are none.

    How many rows there are does not depend on the columns that are read: each line is parsed as text.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", RAW_OR_CORRUPT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(parsed.alias("r")).select("r.*")


def read_messages(spark: SparkSession, path, envelope: bool = False) -> DataFrame:
    """Raw records from JSON files: one record per line, or ``{"messages": [...]}`` documents.

    Lines that are no record are in ``unreadable_lines``. Line files split
    freely; an envelope is one document per file and is read whole by a task.
    """
    if envelope:
        docs = spark.read.schema(RAW_ENVELOPE).option("multiLine", True).json(path)
        return docs.select(F.inline("messages"))
    return read_lines(spark, path).filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def unreadable_lines(spark: SparkSession, path) -> DataFrame:
    """The lines of record files that are no record."""
    return read_lines(spark, path).filter(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")


def parse_records(df: DataFrame, column: str = "value") -> DataFrame:
    """Raw records from JSON text already in a table; text that is no record is dropped."""
    parsed = df.select(F.from_json(column, RAW).alias("r")).filter(F.col("r").isNotNull())
    return parsed.select("r.*").filter(F.coalesce("id", "timestamp", "username").isNotNull())


def normalize_messages(raw: DataFrame, keep=()) -> DataFrame:
    """Raw records to the messages table; records without a readable time are dropped."""
    user_id = F.coalesce(F.nullif(tx.tag("tags", "user-id"), F.lit("")), F.col("username"))
    return raw.select(
        "id",
        tx.parse_ts("timestamp").alias("ts"),
        user_id.alias("user_id"),
        "username",
        "text",
        tx.tag("tags", "emotes").alias("emotes_tag"),
        tx.role_of(tx.tag("tags", "badges")).alias("role"),
        "channel",
        *keep,
    ).filter(F.col("ts").isNotNull())


def empty_messages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MESSAGES)


def room_id(raw: DataFrame, by=("channel",)) -> DataFrame:
    """The ``room-id`` of the earliest record that has one, per channel."""
    by = keys(by)
    room = F.nullif(tx.tag("tags", "room-id"), F.lit(""))
    first = F.min(F.when(room.isNotNull(), F.struct(tx.parse_ts("timestamp").alias("ts"), "id", room.alias("room"))))
    return raw.groupBy(*by).agg(first.getField("room").alias("room_id"))


def dedupe_by_id(df: DataFrame, arrival: list[Column]) -> DataFrame:
    """The last arrived row per id; rows without id are all kept.

    The rank filter keeps one row per id and task before the shuffle, so many
    copies of one id cost no more than many ids.
    """
    from pyspark.sql import Window

    latest = Window.partitionBy("id").orderBy(*[a.desc() for a in arrival])
    named = df.filter(F.col("id").isNotNull()).withColumn("__n", F.row_number().over(latest))
    return named.filter(F.col("__n") == 1).drop("__n").unionByName(df.filter(F.col("id").isNull()))


def dedupe_repeated(df: DataFrame, arrival: list[Column]) -> DataFrame:
    """``dedupe_by_id`` of a written table, for which only rows of ids that come several times are shuffled."""
    sure, maybe = by_repetition(df)
    return sure.unionByName(dedupe_by_id(maybe, arrival))


def by_repetition(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a written table whose id surely comes once, and the others.

    Ids are counted first. Those found twice are bits of a filter of fixed size, which is broadcast: at most REPEAT_BITS / 32 rows,
    whatever their number. Rows that it does not name have an id of their own; the others are few of them by chance.
    """
    bit = F.pmod(F.xxhash64("id"), F.lit(REPEAT_BITS))
    one = F.expr("shiftleft(1L, cast(__bit & 31 as int))")
    twice = df.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(bit.alias("__bit"))
    words = twice.groupBy(F.shiftright("__bit", 5).alias("__word")).agg(F.bit_or(one).alias("__mask"))
    rows = df.withColumn("__bit", bit).withColumn("__word", F.shiftright("__bit", 5)).join(F.broadcast(words), "__word", "left")
    rows = rows.withColumn("__hit", F.coalesce(F.col("__mask").bitwiseAND(one) != 0, F.lit(False)))
    return tuple(rows.filter(test).select(*df.columns) for test in (~F.col("__hit"), F.col("__hit")))


def superseded(df: DataFrame, arrival: list[Column], file: str, row: str) -> DataFrame:
    """Rows of written files that ``dedupe_by_id`` leaves out: ``file``, ``__word`` and ``__lost``, the bits of 64 rows of the file.

    ``row`` is the place of a row in its file. Only places and what orders the copies are shuffled, not the rows.
    """
    _, maybe = by_repetition(df)
    named = maybe.filter(F.col("id").isNotNull())
    last = named.groupBy("id").agg(F.max(F.struct(*(a.alias(f"a{k}") for k, a in enumerate(arrival)), F.col(file), F.col(row))).alias("last"))
    here, last = named.select(file, row, F.lit(False).alias("stays")), last.select(f"last.{file}", f"last.{row}", F.lit(True).alias("stays"))
    bit = F.expr(f"shiftleft(1L, cast({row} & 63 as int))")
    marks = [F.bit_or(F.when(test, bit).otherwise(F.lit(0).cast("bigint"))) for test in (~F.col("stays"), F.col("stays"))]
    words = here.unionByName(last).groupBy(file, F.shiftright(row, 6).alias("__word"))
    lost = words.agg(marks[0].bitwiseAND(F.bitwise_not(marks[1])).alias("__lost"))
    return lost.filter(F.col("__lost") != 0)


def pool_channels(frames: dict[str, DataFrame]) -> DataFrame:
    """Tables of several channels as one, tagged with the channel, one row per id."""
    pooled = None
    for place, (channel, frame) in enumerate(frames.items()):
        rows = frame.withColumn("channel", F.lit(channel)).withColumn("__place", F.lit(place))
        pooled = rows if pooled is None else pooled.unionByName(rows)
    return dedupe_by_id(pooled, [F.col("__place"), F.col("ts")]).drop("__place")
