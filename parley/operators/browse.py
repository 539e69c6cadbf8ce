"""Log-browser queries over the messages table."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.constants import SUGGESTION_LIMIT
from parley.functions import text as tx
from parley.functions.core import time_cell, top_k
from parley.operators.activity import last_by_time
from parley.operators.filters import filter_channel, filter_user, has_text, slice_window
from parley.sources import store

MAX_PAGE = 1000
MAX_RANDOM = 100


def page(df: DataFrame, limit: int = 50, offset: int = 0, reverse: bool = False) -> DataFrame:
    """One page in time order, ties settled by id.

    Messages are counted per minute first; only the minutes the page falls in
    are then put in order.
    """
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    order = [F.desc("ts"), F.desc("id")] if reverse else [F.asc("ts"), F.asc("id")]
    rows = df.withColumn("__cell", time_cell("ts", "1 minute"))
    hit = _cells_of(rows.groupBy("__cell").agg(F.count("*").alias("__size")), limit, offset, reverse)
    near = rows.join(hit.select("__cell", "__before"), "__cell")
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__cell").orderBy(*order))
    found = near.withColumn("__place", place).filter((F.col("__place") > offset) & (F.col("__place") <= offset + limit))
    return found.orderBy("__place").drop("__cell", "__before", "__place")


def _cells_of(sizes: DataFrame, limit: int, offset: int, reverse: bool) -> DataFrame:
    """The cells (``__cell``, ``__size``) that places offset to offset + limit fall in, with the rows before each."""
    along = Window.orderBy(F.desc("__cell") if reverse else F.asc("__cell"))
    upto = F.sum("__size").over(along.rowsBetween(Window.unboundedPreceding, 0))
    places = sizes.withColumn("__before", upto - F.col("__size"))
    return places.filter((F.col("__before") < offset + limit) & (F.col("__before") + F.col("__size") > offset))


def stored_page(
    spark: SparkSession, root: str, channel: str, limit: int = 50, offset: int = 0, reverse: bool = False, id_type: str = "channel"
) -> DataFrame:
    """One page of a stored channel, found through the counts of messages that the merges keep.

    Counts per month, then per minute of the months hit, tell the minutes of the page, at most ``limit`` of them; only their stretch of
    the store is read, however deep the page lies. Messages without a time are not part of it.
    """
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    at = store.snapshot(spark, root)
    counts = store.minutes(spark, root, channel, id_type, at).filter(F.col("minute").isNotNull())
    months = counts.groupBy(F.col("year_month").alias("__cell")).agg(F.sum("messages").alias("__size"))
    hit = _cells_of(months, limit, offset, reverse).collect()
    offset -= min((r["__before"] for r in hit), default=0)
    inside = counts.filter(F.col("year_month").isin([r["__cell"] for r in hit]))
    sizes = inside.groupBy(F.col("minute").alias("__cell")).agg(F.sum("messages").alias("__size"))
    cells = _cells_of(sizes, limit, offset, reverse).collect() if hit else []
    if not cells:
        return spark.createDataFrame([], store.STORED)
    start, last = min(r["__cell"] for r in cells), max(r["__cell"] for r in cells)
    rows = store.read_store(spark, root, channel, start, last + timedelta(minutes=1), id_type, at)
    return page(rows, limit, offset - min(r["__before"] for r in cells), reverse)


def _window(df: DataFrame, start, end) -> DataFrame:
    return df if start is None and end is None else slice_window(df, start or "0001-01-01", end or "9999-12-31")


def list_channels(df: DataFrame) -> DataFrame:
    return df.select("channel").distinct()


def available_days(df: DataFrame, channels=None) -> DataFrame:
    """Calendar days with messages, per channel."""
    scoped = df if channels is None else filter_channel(df, channels)
    days = scoped.select("channel", F.to_date("ts").alias("day")).distinct()
    return days.select(
        "channel", F.year("day").alias("year"), F.month("day").alias("month"), F.dayofmonth("day").alias("day")
    )


def name_history(df: DataFrame, user_id: str) -> DataFrame:
    """Logins of one user id, each with its first and last use."""
    return (
        filter_user(df, user_id, "userid")
        .groupBy(F.col("username").alias("user_login"))
        .agg(F.min("ts").alias("first_timestamp"), F.max("ts").alias("last_timestamp"))
    )


def user_stats(df: DataFrame, channel: str, user: str, kind: str = "user", start=None, end=None) -> DataFrame:
    """Id, login and number of messages of one user in one channel."""
    rows = _window(filter_user(filter_channel(df, channel), user, kind), start, end)
    logins = rows.groupBy("user_id", "username").agg(F.count("*").alias("m"), F.max("ts").alias("last_ts"))
    return logins.groupBy("user_id").agg(
        last_by_time("username").alias("user_login"), F.sum("m").alias("message_count")
    )


def channel_stats(df: DataFrame, channel: str, start=None, end=None) -> DataFrame:
    """Number of messages of one channel."""
    return _window(filter_channel(df, channel), start, end).agg(F.count("*").alias("message_count"))


def channel_top_chatters(df: DataFrame, channel: str, n: int = 10, start=None, end=None) -> DataFrame:
    """The users with the most messages of one channel."""
    rows = _window(filter_channel(df, channel), start, end)
    logins = rows.groupBy("user_id", "username").agg(F.count("*").alias("m"), F.max("ts").alias("last_ts"))
    users = logins.groupBy("user_id").agg(
        last_by_time("username").alias("user_login"), F.sum("m").alias("message_count")
    )
    return top_k(users, n, [F.desc("message_count"), F.asc("user_id")])


def search(df: DataFrame, channel: str, user: str, query: str, kind: str = "user", **paging) -> DataFrame:
    """Messages of one user that contain the query."""
    return page(filter_user(filter_channel(df, channel), user, kind).filter(has_text(query)), **paging)


def channel_logs(df: DataFrame, channel: str, start=None, end=None, **paging) -> DataFrame:
    return page(_window(filter_channel(df, channel), start, end), **paging)


def user_logs(df: DataFrame, channel: str, user: str, kind: str = "user", start=None, end=None, **paging) -> DataFrame:
    return page(_window(filter_user(filter_channel(df, channel), user, kind), start, end), **paging)


def _span(first: str, unit: str) -> Column:
    low = F.lit(first).cast("timestamp_ntz")
    return (F.col("ts") >= low) & (F.col("ts") < low + F.expr(f"interval 1 {unit}"))


def channel_logs_on(df: DataFrame, channel: str, day: str, **paging) -> DataFrame:
    """One calendar day (``YYYY-MM-DD``) of a channel; a range on ts, so it reaches the scan."""
    return page(filter_channel(df, channel).filter(_span(day, "day")), **paging)


def user_logs_in(df: DataFrame, channel: str, user: str, month: str, kind: str = "user", **paging) -> DataFrame:
    """One calendar month (``YYYY-MM``) of a user."""
    rows = filter_user(filter_channel(df, channel), user, kind).filter(_span(f"{month}-01", "month"))
    if "year_month" in df.columns:
        rows = rows.filter(F.col("year_month") == month.replace("-", "_"))
    return page(rows, **paging)


def _draw(df: DataFrame, n: int, seed: int) -> DataFrame:
    if not 1 <= n <= MAX_RANDOM:
        raise ValueError(f"n must be between 1 and {MAX_RANDOM}")
    name = F.coalesce(F.col("id"), F.concat_ws("|", "username", tx.iso_ts("ts"), F.md5(F.col("text").cast("binary"))))
    ticket = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    return df.orderBy(ticket, name).limit(n)


def random_channel(df: DataFrame, channel: str, n: int = 1, seed: int = 0) -> DataFrame:
    """n messages of a channel in an order fixed by the seed."""
    return _draw(filter_channel(df, channel), n, seed)


def random_user(df: DataFrame, channel: str, user: str, kind: str = "user", n: int = 1, seed: int = 0) -> DataFrame:
    """n messages of a user in an order fixed by the seed."""
    return _draw(filter_user(filter_channel(df, channel), user, kind), n, seed)


def merge_pages(*pages: DataFrame) -> DataFrame:
    """Pages that may overlap, without repeats and in time order: one row per id, else per (login, text, time).

    Of several rows the one of the last page stays, and within a page the latest. Whole rows are shuffled once, into the order of time:
    repeats that share a time meet there. An id that comes at several times is found by id and time alone; each time of it that
    goes is one more row, without a text, which is put first at its place and takes what it finds there along.
    """
    rows = None
    for place, part in enumerate(pages):
        part = part.withColumn("__place", F.lit(place))
        rows = part if rows is None else rows.unionByName(part)
    no_id = F.coalesce(F.length("id") == 0, F.lit(True))
    marked = rows.withColumn("__id", F.when(~no_id, F.col("id")))
    gone = _times_left(marked).withColumn("__place", F.lit(len(pages)))
    placed = marked.unionByName(gone, allowMissingColumns=True).repartitionByRange("ts", "__id")
    stamp = F.when(F.col("__id").isNull(), F.struct("username", tx.text_key("text").alias("text")))
    latest = Window.partitionBy("ts", "__id", "__stamp").orderBy(F.desc("__place"), F.asc(tx.text_key("text")))
    kept = placed.withColumn("__stamp", stamp).withColumn("__n", F.row_number().over(latest))
    kept = kept.filter((F.col("__n") == 1) & (F.col("__place") < len(pages)))
    return kept.sortWithinPartitions("ts", "id").drop("__id", "__stamp", "__n", "__place")


def _times_left(rows: DataFrame) -> DataFrame:
    """(__id, ts) of the times at which an id stands besides the one that stays: the latest of its last page."""
    times = rows.filter(F.col("__id").isNotNull()).select("__id", "ts", "__place").repartition("__id")
    times = times.groupBy("__id", "ts").agg(F.max("__place").alias("__place"))
    last = F.max(F.struct("__place", "ts")).over(Window.partitionBy("__id"))
    return times.withColumn("__last", last).filter(~F.col("ts").eqNullSafe(F.col("__last.ts"))).select("__id", "ts")


def suggest_channels(df: DataFrame, query: str = "", taken=(), limit: int = SUGGESTION_LIMIT) -> DataFrame:
    """Channels containing the query, without those already chosen."""
    rows = list_channels(df).filter(F.contains(F.lower("channel"), F.lit(query.strip().lower())))
    used = [t.strip().lower() for t in taken if t.strip()]
    if used:
        rows = rows.filter(~F.lower("channel").isin(*used))
    return rows.orderBy("channel").limit(limit)
