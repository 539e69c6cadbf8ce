"""The activity roll-up most user and calendar analyses read.

One row per (keys, user, login, channel, role, hour) with counts and extremes
of fixed width, so it is a hash aggregate with map-side combine: a user who
wrote a third of all messages shrinks to at most one row per hour and task
before anything is shuffled. Every operator that takes messages here also
takes the roll-up itself, which lets a caller compute it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.core import keys, time_cell

MARK = "msg_count"


def activity(df: DataFrame, by=()) -> DataFrame:
    """Roll messages up to user and hour; a roll-up is returned as it is."""
    if MARK in df.columns:
        return df
    length = F.length("text").cast("bigint")
    columns = [c for c in ("user_id", "username", "channel", "role") if c in df.columns and c not in keys(by)]
    return df.groupBy(*keys(by), *columns, time_cell("ts", "1 hour").alias("hour_ts")).agg(
        F.count("*").alias(MARK),
        F.sum(length).alias("len_sum"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def day() -> Column:
    return F.to_date("hour_ts")


def last_by_time(value: str, ts: str = "last_ts") -> Column:
    """Aggregate: the value of the latest row; equal times are settled by the value itself."""
    return F.max(F.struct(ts, value)).getField(value)


def user_totals(df: DataFrame, by=()) -> DataFrame:
    """Messages per user."""
    return activity(df, by).groupBy(*keys(by), "user_id").agg(F.sum(MARK).alias("messages"))
