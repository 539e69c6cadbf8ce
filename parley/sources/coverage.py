"""Which spans of time are stored: interval tables and what is still to load.

An interval table has ``channel_key, cov_from, cov_to`` (half-open, UTC). The
``by`` keys name the tables kept apart, normally the channel key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley import constants as C
from parley.functions.core import keys

KEY = ("channel_key",)


def months_in(windows: DataFrame, by=KEY) -> DataFrame:
    """Calendar months touched by [need_from, need_to], with their bounds."""
    by = keys(by)
    first = F.trunc("need_from", "MM")
    months = F.sequence(first, F.trunc("need_to", "MM"), F.expr("interval 1 month"))
    start = F.col("month").cast("timestamp_ntz")
    return windows.withColumn("month", F.explode(months)).select(
        *windows.columns,
        F.date_format("month", "yyyy_MM").alias("year_month"),
        start.alias("month_start"),
        F.add_months("month", 1).cast("timestamp_ntz").alias("month_end"),
    )


def merge(intervals: DataFrame, by=KEY) -> DataFrame:
    """Union of overlapping and touching intervals; empty ones are ignored."""
    by = keys(by)
    order = Window.partitionBy(*by).orderBy("cov_from", "cov_to")
    before = F.max("cov_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.coalesce((F.col("cov_from") > before).cast("int"), F.lit(1))).over(
        order.rowsBetween(Window.unboundedPreceding, 0)
    )
    spans = intervals.filter(F.col("cov_from") < F.col("cov_to")).select(*by, "cov_from", "cov_to").distinct()
    return (
        spans.withColumn("__island", island)
        .groupBy(*by, "__island")
        .agg(F.min("cov_from").alias("cov_from"), F.max("cov_to").alias("cov_to"))
        .drop("__island")
    )


def gaps(intervals: DataFrame, needs: DataFrame, by=KEY) -> DataFrame:
    """Parts of each need that no interval covers. ``needs`` has one row per key."""
    by = keys(by)
    joined = needs.select(*by, "need_from", "need_to").join(merge(intervals, by), by, "left")
    touching = (F.col("cov_to") > F.col("need_from")) & (F.col("cov_from") < F.col("need_to"))
    # An empty interval at the end of the need closes the last gap.
    inside = joined.filter(touching).select(
        *by, "need_from", "need_to", F.greatest("cov_from", "need_from").alias("s"), F.least("cov_to", "need_to").alias("e")
    )
    closing = needs.select(*by, "need_from", "need_to", F.col("need_to").alias("s"), F.col("need_to").alias("e"))
    order = Window.partitionBy(*by).orderBy("s", "e")
    opened = F.coalesce(F.lag("e").over(order), F.col("need_from"))
    return (
        inside.unionByName(closing)
        .select(*by, opened.alias("gap_from"), F.col("s").alias("gap_to"))
        .filter(F.col("gap_from") < F.col("gap_to"))
    )


def covers(intervals: DataFrame, needs: DataFrame, by=KEY) -> DataFrame:
    """Whether a single merged interval contains the whole need."""
    by = keys(by)
    joined = needs.select(*by, "need_from", "need_to").join(merge(intervals, by), by, "left")
    inside = (F.col("cov_from") <= F.col("need_from")) & (F.col("cov_to") >= F.col("need_to"))
    return joined.groupBy(*by, "need_from", "need_to").agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("covered"))


def after_fetch(spans: DataFrame, by=KEY) -> DataFrame:
    """What finished downloads attest: a cut-off span only reaches its own latest message."""
    end = F.when(F.col("truncated"), F.col("max_ts")).otherwise(F.col("span_to"))
    return spans.select(*keys(by), F.col("span_from").alias("cov_from"), end.alias("cov_to")).filter(
        F.col("cov_from") < F.col("cov_to")
    )


def month_state(months: DataFrame, now: Column) -> DataFrame:
    """Immutable once the month ended over an hour ago; stale when live and older than 15 minutes.

    Reads ``month_start, month_end, fetched_at, truncated, covered``.
    """
    immutable = F.col("month_end") < now - F.expr(f"interval {C.IMMUTABLE_MARGIN_S} seconds")
    old = F.timestamp_diff("SECOND", F.col("fetched_at"), now) >= C.LIVE_TTL_S
    return months.withColumns(
        {
            "immutable": immutable,
            "stale": ~immutable & old,
            "complete": ~F.col("truncated") & F.col("covered"),
        }
    )


def refresh_plan(intervals: DataFrame, needs: DataFrame, force: bool = False, by=KEY) -> DataFrame:
    """Spans to load per need.

    ``needs`` carries ``need_from, need_to`` and, where something is stored,
    ``fetched_at`` and ``stale``. Gaps are widened by the overlap inside the
    need. A stale need is also reloaded from shortly before its last download;
    that tail joins the last gap when they meet. A covered need that is
    settled, fresh, or downloaded after its end needs nothing.
    """
    by = keys(by)
    whole = needs.select(*by, F.col("need_from").alias("span_from"), F.col("need_to").alias("span_to"))
    if force:
        return whole
    wide = F.expr(f"interval {C.REFRESH_OVERLAP_MINUTES} minutes")
    never = needs.filter(F.col("fetched_at").isNull())
    stored = needs.filter(F.col("fetched_at").isNotNull())
    holes = gaps(intervals, stored, by).join(stored, by).select(
        *by,
        F.greatest(F.col("gap_from") - wide, F.col("need_from")).alias("span_from"),
        F.least(F.col("gap_to") + wide, F.col("need_to")).alias("span_to"),
        F.lit(False).alias("tail"),
    )
    settled = covers(intervals, stored, by).select(*by, "covered")
    late = stored.join(settled, by).filter(
        F.col("stale") & ~(F.col("covered") & (F.col("fetched_at") >= F.col("need_to")))
    )
    tails = late.select(
        *by,
        F.greatest(F.col("fetched_at") - wide, F.col("need_from")).alias("span_from"),
        F.col("need_to").alias("span_to"),
        F.lit(True).alias("tail"),
    ).filter(F.col("span_from") < F.col("span_to"))
    # The tail ends with the need, so it can only meet the last gap.
    order = Window.partitionBy(*by).orderBy("tail", "span_from")
    spans = holes.unionByName(tails)
    next_tail = F.lead("tail").over(order) & ~F.col("tail")
    meets_next = next_tail & (F.col("span_to") >= F.lead("span_from").over(order))
    met = F.col("tail") & (F.lag("span_to").over(order) >= F.col("span_from"))
    merged = spans.select(
        *by,
        F.when(met, F.least(F.lag("span_from").over(order), F.col("span_from"))).otherwise(F.col("span_from")).alias("f"),
        F.when(met, F.greatest(F.lag("span_to").over(order), F.col("span_to"))).otherwise(F.col("span_to")).alias("t"),
        F.coalesce(meets_next, F.lit(False)).alias("gone"),
    )
    planned = merged.filter(~F.col("gone")).select(*by, F.col("f").alias("span_from"), F.col("t").alias("span_to"))
    fresh = never.select(*by, F.col("need_from").alias("span_from"), F.col("need_to").alias("span_to"))
    return planned.unionByName(fresh)


def clamp_to_calendar(needs: DataFrame, messages: DataFrame, by=("channel",)) -> DataFrame:
    """Cut each need to the logged days of its channel; flag needs that lie outside them."""
    by = keys(by)
    logged = messages.groupBy(*by).agg(
        F.to_date(F.min("ts")).cast("timestamp_ntz").alias("first_day"),
        (F.to_date(F.max("ts")) + 1).cast("timestamp_ntz").alias("end_day"),
    )
    cut = needs.join(logged, by, "left").withColumns(
        {
            "clamped_from": F.greatest("need_from", "first_day"),
            "clamped_to": F.least("need_to", "end_day"),
        }
    )
    return cut.select(
        *by,
        "need_from",
        "need_to",
        "clamped_from",
        "clamped_to",
        (F.col("first_day").isNotNull() & (F.col("clamped_from") >= F.col("clamped_to"))).alias("outside"),
    )


def run_metadata(months: DataFrame) -> DataFrame:
    """For the touched months (``fetched, truncated, fetched_at``): cut off, all from store, newest download."""
    any_fetch = F.coalesce(F.bool_or("fetched"), F.lit(False))
    return months.agg(
        F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"),
        (~any_fetch).alias("from_cache"),
        F.when(~any_fetch, F.max("fetched_at")).alias("cached_at"),
    )
