"""A whole statistics run: pooled sections, channels side by side, and the comparison period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import channel_key
from parley.operators.filters import filter_channel, filter_user, slice_window
from parley.plans import channels, compare
from parley.plans.bundle import Shared, chat_stats
from parley.plans.params import Params
from parley.sources import store
from parley.sources.catalog import catalog_union
from parley.sources.coverage import clamp_to_calendar


def load(spark: SparkSession, root: str, params: Params) -> DataFrame:
    """The stored messages a run needs: its range and, when compared, the other period."""
    start, end = params.from_date, params.to_date
    if params.compare_previous:
        before = params.comparison_window()
        start, end = min(start, before[0]), max(end, before[1])
    return store.read_store(spark, root, params.channels, start, end, params.channel_id_type)


def history(spark: SparkSession, root: str, params: Params) -> DataFrame:
    """When the channels asked for have stored messages, over all months: ``channel`` and ``ts``, from the counts per minute."""
    asked = channels.needs(spark, params).select("channel", channel_key("channel", params.channel_id_type).alias("channel_key"))
    logged = store.minutes(spark, root, params.channels, params.channel_id_type)
    return logged.join(asked, "channel_key").select("channel", F.col("minute").alias("ts"))


def report(
    messages: DataFrame,
    params: Params,
    catalog: DataFrame | None = None,
    keep: str | None = None,
    logged: DataFrame | None = None,
) -> dict[str, dict[str, DataFrame]]:
    """All parts of a run as lazy tables.

    ``logged`` is ``history``, or any table of (channel, ts): channels whose range lies outside their logged days are named in the
    checks. By default only ``messages`` themselves tell.
    The user filter applies to the pooled and per-channel sections; summaries
    and the comparison describe everybody, unless ``user_everywhere`` is set.
    ``catalog`` holds the names per channel; pooled sections use their union.
    """
    logged = messages if logged is None else logged
    if params.user is not None and params.user_everywhere:
        messages = filter_user(messages, params.user, params.user_id_type)
    scoped = filter_channel(messages, params.channels)
    current = slice_window(scoped, params.from_date, params.to_date)
    names = None if catalog is None else catalog_union(catalog, params.channels)
    # Pooled and per-channel sections read the same counts per channel: the messages are counted once for both.
    base = Shared(current, None, channels.BY, keep) if len(params.channels) > 1 else None
    shared = None if params.user is not None else Shared(current, names, keep=keep, fine=base)
    out = {"pooled": chat_stats(current, params, names, shared=shared)}
    if len(params.channels) > 1:
        out["summaries"] = channels.channel_summaries(current, params.channels, catalog)
        fine = None if params.user is not None else base
        out["per_channel"] = channels.per_channel(current, params, catalog, keep, fine)
        totals = out["summaries"]["totals"]
        pooled = current.agg(F.count("*").alias("total_messages"))
        out["summaries"]["share"] = channels.channel_share(totals)
        outside = clamp_to_calendar(channels.needs(messages.sparkSession, params), channels.plain_names(logged))
        out["summaries"]["checks"] = channels.reconcile(totals, pooled, outside)
    if params.compare_previous:
        both = compare.labelled(scoped, params)
        out["comparison"] = {
            **compare.period_metrics(both, names),
            "movers": compare.top_movers(both),
            "table": compare.comparison_table(both, names),
            "headlines": compare.headline_table(both, names),
            "days": compare.overlay(both),
        }
    return out
