"""Hours, weekdays, days, 5-minute bins, trend and seasonality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley import constants as C
from parley.functions.core import keys, partition, spine, time_cell, top_k
from parley.operators.activity import MARK, activity, day


def hourly(df: DataFrame, by=()) -> DataFrame:
    """Messages per UTC hour, all 24 hours."""
    by = keys(by)
    counts = activity(df, by).groupBy(*by, F.hour("hour_ts").alias("hour")).agg(F.sum(MARK).alias("messages"))
    return spine(counts, by, "hour", 24).join(counts, [*by, "hour"], "left").fillna(0, ["messages"])


def weekday_hour(df: DataFrame, by=()) -> DataFrame:
    """Heat map of messages per weekday (Monday = 0) and hour, all 168 cells."""
    by = keys(by)
    slot = (F.weekday("hour_ts") * 24 + F.hour("hour_ts")).alias("slot")
    counts = activity(df, by).groupBy(*by, slot).agg(F.sum(MARK).alias("messages"))
    dense = spine(counts, by, "slot", 168).join(counts, [*by, "slot"], "left").fillna(0, ["messages"])
    return dense.select(
        *by, F.floor(F.col("slot") / 24).cast("int").alias("weekday"), (F.col("slot") % 24).alias("hour"), "messages"
    )


def calendar(days: DataFrame, by=()) -> DataFrame:
    """Every day between the first and the last one, per key."""
    by = keys(by)
    ends = days.groupBy(*by).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    return ends.select(*by, F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day"))


def per_day(df: DataFrame, by=()) -> DataFrame:
    """Messages per calendar day, days without messages included."""
    by = keys(by)
    counts = activity(df, by).groupBy(*by, day().alias("day")).agg(F.sum(MARK).alias("messages"))
    return calendar(counts, by).join(counts, [*by, "day"], "left").fillna(0, ["messages"])


def bins_5m(df: DataFrame, by=()) -> DataFrame:
    """Non-empty 5-minute bins: messages and distinct users."""
    by = keys(by)
    return df.groupBy(*by, time_cell("ts", f"{C.BIN_MINUTES} minutes").alias("window_start")).agg(
        F.count("*").alias("message_count"), F.count_distinct("user_id").alias("unique_chatters")
    )


def bin_users(df: DataFrame, by=()) -> DataFrame:
    """Messages per 5-minute bin and user: counts that add up over channels, which distinct users do not."""
    return df.groupBy(*keys(by), time_cell("ts", f"{C.BIN_MINUTES} minutes").alias("window_start"), "user_id").agg(F.count("*").alias("n"))


def bins_of_users(users: DataFrame, by=()) -> DataFrame:
    """``bins_5m`` from the counts per user."""
    per_bin = users.groupBy(*keys(by), "window_start")
    return per_bin.agg(F.sum("n").alias("message_count"), F.count_distinct("user_id").alias("unique_chatters"))


def peaks_5m(bins: DataFrame, n: int = 3, by=()) -> DataFrame:
    """The n bins with the most messages."""
    by = keys(by)
    top = top_k(bins, n, [F.desc("message_count"), F.asc("window_start")], by)
    return top.select(*by, "window_start", "message_count")


def peak_concurrency(bins: DataFrame, by=()) -> DataFrame:
    """The bin with the most distinct users."""
    by = keys(by)
    top = top_k(bins, 1, [F.desc("unique_chatters"), F.asc("window_start")], by)
    return top.select(
        *by,
        F.col("unique_chatters").alias("peak_concurrent_chatters"),
        F.col("window_start").alias("peak_concurrent_window"),
    )


def trend(daily: DataFrame, by=()) -> DataFrame:
    """Centred 7-day moving average of a daily table; nothing below 7 days."""
    by = keys(by)
    around = partition(by).orderBy("day").rowsBetween(-C.TREND_HALF_WIDTH, C.TREND_HALF_WIDTH)
    smoothed = daily.select(
        *by,
        "day",
        "messages",
        F.round(F.avg("messages").over(around), 2).alias("trend"),
        F.count("*").over(partition(by)).alias("days"),
    )
    return smoothed.filter(F.col("days") >= C.MIN_TREND_DAYS).drop("days")


def weekly_seasonality(daily: DataFrame, by=()) -> DataFrame:
    """Mean ratio of a weekday to its trend, scaled so that the seven average to 1."""
    by = keys(by)
    ratios = (
        trend(daily, by)
        .filter(F.col("trend") > 0)
        .groupBy(*by, F.weekday("day").alias("weekday"))
        .agg(F.avg(F.col("messages") / F.col("trend")).alias("ratio"))
    )
    # A weekday without a usable day counts as 1; ranges below a week have no rows to start from.
    wide = ratios.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("weekday", "ratio"))).alias("ratios"))
    week = F.transform(
        F.sequence(F.lit(0), F.lit(6)), lambda d: F.coalesce(F.try_element_at(F.col("ratios"), d), F.lit(1.0))
    )
    mean = F.aggregate(F.col("week"), F.lit(0.0), lambda a, x: a + x) / F.lit(7.0)
    return (
        wide.withColumn("week", week)
        .filter(F.size("ratios") > 0)
        .select(*by, mean.alias("mean"), F.posexplode("week").alias("weekday", "ratio"))
        .select(*by, "weekday", F.round(F.col("ratio") / F.when(F.col("mean") > 0, F.col("mean")).otherwise(F.lit(1.0)), 4).alias("weekday_index"))
    )


def first_message_hours(df: DataFrame, by=()) -> DataFrame:
    """Hour of each user's first message in the range, all 24 hours."""
    by = keys(by)
    first = activity(df, by).groupBy(*by, "user_id").agg(F.min("first_ts").alias("first_ts"))
    counts = first.groupBy(*by, F.hour("first_ts").alias("hour")).agg(F.count("*").alias("users"))
    return spine(counts, by, "hour", 24).join(counts, [*by, "hour"], "left").fillna(0, ["users"])


def new_returning(df: DataFrame, by=()) -> DataFrame:
    """Per day, users on their first day and users seen before; quiet days included.

    The set of days of one user is bounded by the days of the range.
    """
    by = keys(by)
    users = activity(df, by).groupBy(*by, "user_id").agg(F.collect_set(day()).alias("days"))
    seen = users.select(*by, F.explode("days").alias("day"), F.array_min("days").alias("first_day"))
    counts = seen.groupBy(*by, "day").agg(
        F.count_if(F.col("day") == F.col("first_day")).alias("new_chatters"),
        F.count_if(F.col("day") > F.col("first_day")).alias("returning_chatters"),
    )
    dense = calendar(counts, by).join(counts, [*by, "day"], "left")
    return dense.fillna(0, ["new_chatters", "returning_chatters"])


def overlay_series(current: DataFrame, previous: DataFrame, value: str = "messages", order: str = "day") -> DataFrame:
    """Two daily series side by side by position; the previous one only when both have equal length."""
    place = F.row_number().over(Window.orderBy(order))
    size = F.count("*").over(Window.partitionBy())
    cur = current.select(place.alias("idx"), F.col(order), F.col(value).alias("current"), size.alias("days"))
    prev = previous.select(place.alias("idx"), F.col(value).alias("previous"), size.alias("days"))
    return cur.join(prev, ["idx", "days"], "left").drop("days")
