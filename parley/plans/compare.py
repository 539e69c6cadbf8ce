"""Two periods side by side, computed in one pass over rows labelled with their period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import constants as C
from parley.functions.core import complete, top_k
from parley.operators import activity as act
from parley.operators import emotes, health, links, overview, roles, temporal, words
from parley.plans.params import Params

BY = ["period"]
CURRENT, PREVIOUS = "current", "previous"

# Which way a metric is good.
UP, DOWN, NEUTRAL = "higher-is-better", "lower-is-better", "neutral"
HEADLINES = {
    "total_messages": UP,
    "unique_chatters": UP,
    "days_spanned": None,
    "avg_message_length": NEUTRAL,
    "median_message_length": NEUTRAL,
    "max_message_length": NEUTRAL,
    "avg_words_per_message": NEUTRAL,
    "vocab_richness": UP,
    "unique_word_count": UP,
    "peak_concurrent_chatters": UP,
}
QUALITY = {
    "self_repetition_count": DOWN,
    "duplicate_message_count": DOWN,
    "non_ascii_ratio": NEUTRAL,
    "cross_user_copy_paste_count": DOWN,
}
CLASSES = ("questions", "exclamations", "all_caps", "emote_only", "short_messages", "long_messages")
PLATFORMS = (*C.PLATFORM_RES, "other")
COPY_PASTE = ("cross_user_copy_paste_count", "cross_user_copy_paste_texts")


def label_periods(df: DataFrame, current, previous) -> DataFrame:
    """Rows of either [from, to) window with a ``period`` column; a row in both appears twice.

    The scan sees one range condition per window, so other months are pruned.
    """
    ntz = lambda v: F.lit(str(v)).cast("timestamp_ntz")
    inside = [(F.col("ts") >= ntz(a)) & (F.col("ts") < ntz(b)) for a, b in (current, previous)]
    labels = F.array_compact(F.array(F.when(inside[0], F.lit(CURRENT)), F.when(inside[1], F.lit(PREVIOUS))))
    return df.filter(inside[0] | inside[1]).withColumn("period", F.explode(labels))


def labelled(df: DataFrame, params: Params) -> DataFrame:
    return label_periods(df, (params.from_date, params.to_date), params.comparison_window())


def period_metrics(both: DataFrame, catalog: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything the comparison shows, each table with a ``period`` column."""
    rollup = act.activity(both, BY)
    bins = temporal.bins_5m(both, BY)
    counts = words.words_apart(emotes.token_counts(both, BY), catalog, BY)
    return {
        "overview": overview.overview(both, BY, rollup),
        "vocabulary": complete(words.vocabulary(counts, BY), rollup, BY, ["unique_word_count"]),
        "peak_concurrency": temporal.peak_concurrency(bins, BY),
        "hourly": temporal.hourly(rollup, BY),
        "per_day": temporal.per_day(rollup, BY),
        "roles": roles.roles(rollup, BY),
        "message_classes": health.message_classes(both, catalog, BY),
        "platform_links": complete(links.platform_links(links.url_counts(both, BY), BY), rollup, BY, PLATFORMS),
        "duplicate_count": health.duplicate_count(health.text_counts(both, BY), BY),
        "self_repetition": health.self_repetition(both, BY),
        "non_ascii": health.non_ascii(both, BY),
        "copy_paste": complete(health.copy_paste_summary(health.copy_paste_events(both, BY), BY), rollup, BY, COPY_PASTE),
    }


def top_movers(both: DataFrame, n: int = C.MOVERS_TOP_N) -> DataFrame:
    """The n largest gains and losses of messages per user; none when a period is empty."""
    rollup = act.activity(both, BY)
    current = F.col("period") == CURRENT
    users = rollup.groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(current, F.col(act.MARK))), F.lit(0)).alias("current"),
        F.coalesce(F.sum(F.when(~current, F.col(act.MARK))), F.lit(0)).alias("previous"),
        F.max(F.struct(current.alias("now"), "last_ts", "username")).getField("username").alias("username"),
    )
    moved = users.withColumn("delta", F.col("current") - F.col("previous")).filter("delta <> 0")
    sides = rollup.agg(F.count_distinct("period")).scalar()
    kind = F.when(F.col("delta") > 0, F.lit("gain")).otherwise(F.lit("loss"))
    top = top_k(moved.withColumn("kind", kind), n, [F.desc(F.abs("delta")), F.asc("user_id")], ["kind"])
    both_there = top.withColumn("sides", sides).filter(F.col("sides") == 2)
    return both_there.select("kind", "user_id", "username", "current", "previous", "delta")


def delta_text(current: Column, previous: Column) -> Column:
    """Signed percentage, or ±0, new, gone; null where a side is missing."""
    pct = (current - previous) / previous * 100.0
    sign = F.when(pct > 0, F.lit("▲ ")).otherwise(F.lit("▼ "))
    return (
        F.when(current.isNull() | previous.isNull(), F.lit(None).cast("string"))
        .when(current == previous, F.lit("±0"))
        .when(previous == 0, F.lit("new"))
        .when(current == 0, F.lit("gone"))
        .otherwise(F.concat(sign, F.format_string("%.1f%%", F.abs(pct))))
    )


def delta_tone(current: Column, previous: Column, direction: Column) -> Column:
    """good, bad or flat, by the direction that is good for the metric."""
    appeared = F.when(direction == DOWN, F.lit("bad")).otherwise(F.lit("good"))
    vanished = F.when(direction == DOWN, F.lit("good")).otherwise(F.lit("bad"))
    grew = current > previous
    return (
        F.when(current.isNull() | previous.isNull(), F.lit(None).cast("string"))
        .when(current == previous, F.lit("flat"))
        .when(previous == 0, appeared)
        .when(current == 0, vanished)
        .when(direction == NEUTRAL, F.lit("flat"))
        .when(grew == (direction == UP), F.lit("good"))
        .otherwise(F.lit("bad"))
    )


def with_delta(table: DataFrame) -> DataFrame:
    """Add text and tone to a table with ``current, previous, direction``."""
    return table.withColumn("delta", delta_text(F.col("current"), F.col("previous"))).withColumn(
        "tone", delta_tone(F.col("current"), F.col("previous"), F.col("direction"))
    )


def _long(table: DataFrame, section: str, columns) -> DataFrame:
    """One row per period and metric of a table with one row per period."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    return table.select("period", F.lit(section).alias("section"), F.inline(pairs))


def _side_by_side(rows: DataFrame, missing: float | None) -> DataFrame:
    """Turn (period, section, metric, value) into current and previous columns."""
    current = F.col("period") == CURRENT
    sides = rows.groupBy("section", "metric").agg(
        F.max(F.when(current, F.col("value"))).alias("current"), F.max(F.when(~current, F.col("value"))).alias("previous")
    )
    if missing is None:
        return sides
    fill = F.when(F.col("section") == "quality", F.lit(None).cast("double")).otherwise(F.lit(missing))
    return sides.withColumns({c: F.coalesce(F.col(c), fill) for c in ("current", "previous")})


def _direction(directions: dict) -> Column:
    out = F.lit(NEUTRAL)
    for metric, direction in directions.items():
        if direction != NEUTRAL:
            out = F.when(F.col("metric") == metric, F.lit(direction)).otherwise(out)
    return out


def _has_baseline(both: DataFrame) -> Column:
    return both.agg(F.coalesce(F.bool_or(F.col("period") == PREVIOUS), F.lit(False))).scalar()


def comparison_table(both: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Roles, message classes, platforms and quality figures of both periods; nothing without a previous period."""
    m = period_metrics(both, catalog)
    role_rows = m["roles"].select(
        "period", F.lit("role").alias("section"), F.col("role").alias("metric"), F.col("messages").cast("double").alias("value")
    )
    rows = (
        role_rows.unionByName(_long(m["message_classes"], "class", CLASSES))
        .unionByName(_long(m["platform_links"], "platform", PLATFORMS))
        .unionByName(_long(m["self_repetition"], "quality", ["self_repetition_count"]))
        .unionByName(_long(m["duplicate_count"], "quality", ["duplicate_message_count"]))
        .unionByName(_long(m["non_ascii"], "quality", ["non_ascii_ratio"]))
        .unionByName(_long(m["copy_paste"], "quality", ["cross_user_copy_paste_count"]))
    )
    table = _side_by_side(rows, 0.0).withColumn("direction", _direction(QUALITY))
    return with_delta(table).withColumn("__base", _has_baseline(both)).filter("__base").drop("__base")


def headline_table(both: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """The ten headline figures of both periods; no delta without a previous period."""
    m = period_metrics(both, catalog)
    totals = [k for k in HEADLINES if k not in ("vocab_richness", "unique_word_count", "peak_concurrent_chatters")]
    rows = (
        _long(m["overview"], "headline", totals)
        .unionByName(_long(m["vocabulary"], "headline", ["vocab_richness", "unique_word_count"]))
        .unionByName(_long(m["peak_concurrency"], "headline", ["peak_concurrent_chatters"]))
    )
    table = _side_by_side(rows, None).withColumn("direction", _direction(HEADLINES))
    plain = F.col("metric") == "days_spanned"
    shown = with_delta(table)
    return shown.select(
        "metric",
        "current",
        "previous",
        *[F.when(~plain, F.col(c)).alias(c) for c in ("delta", "tone")],
    )


def overlay(both: DataFrame) -> DataFrame:
    """Messages per day of both periods by position in their period."""
    daily = temporal.per_day(act.activity(both, BY), BY)
    side = lambda p: daily.filter(F.col("period") == p).drop("period")
    return temporal.overlay_series(side(CURRENT), side(PREVIOUS))
