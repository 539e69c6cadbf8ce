"""Several channels side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import constants as C
from parley.functions.core import complete
from parley.operators import activity as act
from parley.operators import emotes, links, mentions, overview, roles, temporal, words
from parley.operators.filters import filter_channel
from parley.plans.bundle import Shared, chat_stats
from parley.plans.params import Params

BY = ["channel"]


def requested(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row per channel asked for, whether it has messages or not."""
    spark = df.sparkSession
    names = F.array(*[F.lit(c) for c in channels])
    return spark.range(1).select(F.explode(names).alias("channel"))


def plain_names(df: DataFrame) -> DataFrame:
    """Channel names as they are asked for: trimmed and in lower case."""
    return df.withColumn("channel", F.lower(F.trim("channel")))


def needs(spark: SparkSession, params: Params) -> DataFrame:
    """The range asked for, per channel, as ``coverage.clamp_to_calendar`` takes it."""
    span = [F.lit(str(t)).cast("timestamp_ntz").alias(n) for t, n in ((params.from_date, "need_from"), (params.to_date, "need_to"))]
    names = F.array(*[F.lit(c.strip().lower()) for c in params.channels])
    return spark.range(1).select(F.explode(names).alias("channel"), *span)


def channel_totals(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Messages, chatters, peak concurrency, first and last message; zeros for silent channels."""
    rollup = act.activity(df)
    totals = rollup.groupBy(*BY).agg(
        F.sum(act.MARK).alias("total_messages"),
        F.count_distinct("user_id").alias("unique_chatters"),
        F.min("first_ts").alias("first_message"),
        F.max("last_ts").alias("last_message"),
    )
    peak = temporal.peak_concurrency(temporal.bins_5m(df, BY), BY).select("channel", "peak_concurrent_chatters")
    return (
        requested(df, channels)
        .join(totals, BY, "left")
        .join(peak, BY, "left")
        .fillna(0, ["total_messages", "unique_chatters"])
    )


def aligned_days(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Messages per day of every requested channel over the span of all of them together."""
    daily = act.activity(df).groupBy(*BY, act.day().alias("day")).agg(F.sum(act.MARK).alias("messages"))
    low, high = daily.agg(F.min("day")).scalar(), daily.agg(F.max("day")).scalar()
    days = requested(df, channels).withColumn("low", low).withColumn("high", high)
    days = days.select("channel", F.explode(F.sequence("low", "high", F.expr("interval 1 day"))).alias("day"))
    return days.join(daily, ["channel", "day"], "left").fillna(0, ["messages"])


def channel_summaries(df: DataFrame, channels: Sequence[str], catalog: DataFrame | None = None) -> dict[str, DataFrame]:
    """The compact per-channel lists. Words leave out the channel's whole catalog, not only what was seen."""
    rollup = act.activity(df)
    size, short = C.SUMMARY_LIST_SIZE, C.SUMMARY_TOP_SIZE
    return {
        "totals": channel_totals(df, channels),
        "days": aligned_days(df, channels),
        "top_chatters": overview.top_chatters(rollup, short, engagement=False, by=BY),
        "top_emotes": emotes.top_emotes(df, catalog, short, BY),
        "top_words": words.top_words(words.word_counts(df, catalog, BY), size, BY),
        "top_commands": words.top_commands(words.command_counts(df, BY), size, BY),
        "top_domains": links.top_domains(links.url_counts(df, BY), size, BY),
        "top_mentions": mentions.top_mentions(mentions.edge_counts(df, BY), size, BY),
        "roles": roles.roles(rollup, BY),
    }


#: Sections with one row per channel, and their columns that are zero where there are no messages.
ONE_ROW = {
    "overview": ("total_messages", "unique_chatters"),
    "chatter_quantiles": (),
    "active_chatters": (),
    "non_ascii": ("messages_with_non_ascii",),
    "self_repetition": ("self_repetition_count",),
    "messages_with_commands": ("messages_with_commands",),
    "messages_with_links": ("messages_with_links",),
    "messages_with_mentions": ("messages_with_mentions",),
    "vocabulary": ("unique_word_count",),
    "zipf_slope": (),
    "unique_urls": ("unique_url_count",),
    "platform_links": (*C.PLATFORM_RES, "other"),
    "duplicate_count": ("duplicate_message_count",),
    "sessions": ("total_sessions",),
    "message_classes": ("questions", "exclamations", "all_caps", "short_messages", "long_messages", "emote_only"),
}
#: Sections with a row for every slot of time, and how many of each there are.
SLOTS = {"hourly": {"hour": 24}, "weekday_hour": {"weekday": 7, "hour": 24}}


def per_channel(
    df: DataFrame, params: Params, catalog: DataFrame | None = None, keep: str | None = None, fine: Shared | None = None
) -> dict[str, DataFrame]:
    """Every selected section per asked channel, each channel with its own catalog.

    ``fine`` holds counts per channel of the same messages that another part of the run reads too.

    A channel without messages has the rows of an empty run: zero counts in
    the sections with one row, and a zero for every hour.
    """
    asked = requested(df, [c.strip().lower() for c in params.channels])
    df = plain_names(filter_channel(df, params.channels))
    out = chat_stats(df, params, catalog, BY, all_urls=False, shared=Shared(df, catalog, BY, keep, fine))
    for name, zeros in ONE_ROW.items():
        if name in out:
            out[name] = complete(out[name], asked, BY, zeros)
    for name, slots in SLOTS.items():
        every = asked
        for slot, size in slots.items():
            every = every.withColumn(slot, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
        out[name] = every.join(out[name], [*BY, *slots], "left").fillna(0, ["messages"])
    return out


def channel_share(totals: DataFrame) -> DataFrame:
    """Percent of all messages and messages per chatter, from the channel totals."""
    everything = F.sum("total_messages").over(temporal.partition([]))
    return totals.select(
        "channel",
        F.round(F.coalesce(F.col("total_messages") / F.nullif(everything, F.lit(0)) * 100.0, F.lit(0.0)), 2).alias("share_pct"),
        F.round(F.col("total_messages") / F.nullif(F.col("unique_chatters"), F.lit(0)), 1).alias("messages_per_chatter"),
    )


def reconcile(totals: DataFrame, pooled_total: DataFrame, outside: DataFrame | None = None) -> DataFrame:
    """Checks over the channels: totals that do not add up, silent channels, channels outside their history.

    ``pooled_total`` has one row and a column ``total_messages``.
    """
    pooled = pooled_total.select("total_messages").scalar()
    silent = F.sort_array(F.collect_list(F.when(F.col("total_messages") == 0, F.col("channel"))))
    base = totals.agg(F.coalesce(F.sum("total_messages"), F.lit(0)).alias("covered"), silent.alias("silent"), F.count("*").alias("channels"))
    base = base.withColumn("pooled", pooled)
    gone = F.lit("")
    if outside is not None:
        names = outside.filter("outside").agg(F.array_join(F.sort_array(F.collect_list("channel")), ", ")).scalar()
        base = base.withColumn("gone", names)
        gone = F.col("gone")
    empty = F.array_join("silent", ", ")
    checks = [
        ("totals_do_not_add_up", F.col("covered") != F.col("pooled"), F.concat_ws(" of ", "covered", "pooled")),
        ("silent_channels", F.size("silent") > 0, F.when(F.size("silent") == F.col("channels"), F.lit("all")).otherwise(empty)),
        ("outside_history", F.length(gone) > 0, gone),
    ]
    table = F.array(*[F.struct(F.lit(n).alias("check"), f.alias("failed"), d.alias("detail")) for n, f, d in checks])
    return base.select(F.inline(table))
