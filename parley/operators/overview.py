"""Totals and per-user aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley import constants as C
from parley.functions import text as tx
from parley.functions.core import attach, keys, top_k
from parley.functions.stats import median, nearest_rank, ranked_histogram
from parley.operators.activity import MARK, activity, day, last_by_time, user_totals


def length_histogram(df: DataFrame, by=()) -> DataFrame:
    """Messages, words and first/last day per message length."""
    return df.groupBy(*keys(by), tx.char_len("text").alias("length")).agg(
        F.count("*").alias("m"),
        F.sum(tx.word_count("text")).alias("words"),
        F.min(F.to_date("ts")).alias("first_day"),
        F.max(F.to_date("ts")).alias("last_day"),
    )


def overview(df: DataFrame, by=(), rollup: DataFrame | None = None) -> DataFrame:
    """Totals: messages, chatters, days, message length and words per message."""
    by = keys(by)
    lengths = ranked_histogram(length_histogram(df, by), "length", by)
    totals = lengths.groupBy(*by).agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("total_messages"),
        F.coalesce(F.datediff(F.max("last_day"), F.min("first_day")) + 1, F.lit(0)).cast("bigint").alias("days_spanned"),
        F.coalesce(F.sum(F.col("length") * F.col("m")) / F.sum("m"), F.lit(0.0)).alias("avg_message_length"),
        median("length").alias("median_message_length"),
        F.max("length").alias("max_message_length"),
        (F.sum("words") / F.sum("m")).alias("avg_words_per_message"),
    )
    users = (rollup if rollup is not None else df).groupBy(*by).agg(F.count_distinct("user_id").alias("unique_chatters"))
    return attach(totals, users, by, ["unique_chatters"]).select(
        *by,
        "total_messages",
        "unique_chatters",
        "days_spanned",
        "avg_message_length",
        "median_message_length",
        "max_message_length",
        "avg_words_per_message",
    )


def chatters(df: DataFrame, by=(), engagement: bool = True) -> DataFrame:
    """One row per user, with the engagement score normalised over all users."""
    by = keys(by)
    rollup = activity(df, by)
    aggs = [
        F.sum(MARK).alias("message_count"),
        last_by_time("username").alias("username"),
        F.min("first_ts").alias("first_seen"),
        F.max("last_ts").alias("last_seen"),
        F.count_distinct(day()).alias("active_days"),
        (F.sum("len_sum") / F.sum(MARK)).alias("avg_length"),
    ]
    if "channel" in rollup.columns and "channel" not in by:
        aggs.append(F.sort_array(F.collect_set("channel")).alias("channels"))
    users = rollup.groupBy(*by, "user_id").agg(*aggs)
    if not engagement:
        return users.withColumn("engagement_score", F.lit(None).cast("double"))
    # The last three keep the columns of both plans alike, so the shuffled roll-up is made once and reused.
    peaks = users.groupBy(*by).agg(
        F.max("message_count").alias("max_count"),
        F.max("active_days").alias("max_days"),
        F.max("avg_length").alias("max_length"),
        F.min("first_seen").alias("since"),
        F.max("last_seen").alias("until"),
        F.max("username").alias("last_name"),
    )
    score = (
        F.lit(0.5) * F.col("message_count") / F.col("max_count")
        + F.lit(0.3) * F.col("active_days") / F.col("max_days")
        + F.lit(0.2) * F.col("avg_length") / F.col("max_length")
    )
    level = ["max_count", "max_days", "max_length", "since", "until", "last_name"]
    scored = attach(users, peaks, by, level)
    return scored.withColumn("engagement_score", F.when(F.col("max_length") > 0, F.round(score, 4))).drop(*level)


def top_chatters(df: DataFrame, n: int = 20, engagement: bool = True, by=()) -> DataFrame:
    """The n users with the most messages."""
    by = keys(by)
    return top_k(chatters(df, by, engagement), n, [F.desc("message_count"), F.asc("user_id")], by)


def chatter_quantiles(df: DataFrame, by=()) -> DataFrame:
    """Nearest-rank quantiles of messages per user."""
    by = keys(by)
    hist = user_totals(df, by).groupBy(*by, "messages").agg(F.count("*").alias("m"))
    ranked = ranked_histogram(hist, "messages", by)
    return ranked.groupBy(*by).agg(
        *[F.round(nearest_rank("messages", q).cast("double"), 2).alias(f"p{round(q * 100)}") for q in C.CHATTER_QUANTILES]
    )


def active_chatters(df: DataFrame, by=()) -> DataFrame:
    """Mean and maximum over days of the distinct users of a day."""
    by = keys(by)
    per_day = activity(df, by).groupBy(*by, day().alias("day")).agg(F.count_distinct("user_id").alias("users"))
    return per_day.groupBy(*by).agg(
        F.avg("users").alias("avg_active_chatters"), F.max("users").alias("peak_active_chatters")
    )
