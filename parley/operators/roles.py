"""Roles and role rosters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley import constants as C
from parley.functions.core import keys, top_k
from parley.operators.activity import MARK, activity, last_by_time


def roles(df: DataFrame, by=()) -> DataFrame:
    """Messages and distinct users per role."""
    by = keys(by)
    return (
        activity(df, by)
        .groupBy(*by, "role")
        .agg(F.sum(MARK).alias("messages"), F.count_distinct("user_id").alias("unique_users"))
    )


def roster(df: DataFrame, wanted: Sequence[str], by=()) -> DataFrame:
    """Users ever seen in one of the roles: their last such role, and all their messages."""
    by = keys(by)
    held = F.when(F.col("role").isin(*wanted), F.struct("last_ts", "role"))
    users = (
        activity(df, by)
        .groupBy(*by, "user_id")
        .agg(
            F.max(held).getField("role").alias("role"),
            last_by_time("username").alias("username"),
            F.sum(MARK).alias("message_count"),
            F.min("first_ts").alias("first_seen"),
            F.max("last_ts").alias("last_seen"),
        )
    )
    return users.filter(F.col("role").isNotNull())


def staff_list(df: DataFrame, by=()) -> DataFrame:
    """Broadcasters, moderators and VIPs."""
    return roster(df, C.STAFF_ROLES, by)


def subscriber_list(df: DataFrame, n: int = 200, by=()) -> DataFrame:
    """The n subscribers with the most messages."""
    by = keys(by)
    return top_k(roster(df, C.SUBSCRIBER_ROLES, by), n, [F.desc("message_count"), F.asc("user_id")], by)


def subscriber_count(df: DataFrame, by=()) -> DataFrame:
    """Distinct subscribers, beside the capped list."""
    by = keys(by)
    return (
        activity(df, by)
        .filter(F.col("role").isin(*C.SUBSCRIBER_ROLES))
        .groupBy(*by)
        .agg(F.count_distinct("user_id").alias("subscriber_count"))
    )
