"""One run over one set of messages: every selected section as a lazy table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import constants as C
from parley.functions.core import complete, keys, top_k
from parley.operators import activity as act
from parley.operators import anomalies, bots, cohorts, concentration, emotes, health, links, mentions
from parley.operators import language as lang
from parley.operators import overview, roles, sessions, temporal, words
from parley.operators.filters import filter_user
from parley.plans.params import Params
from parley.session import checkpointed, kept_path


class Shared:
    """Intermediates several sections read, each described once.

    ``keep="disk"`` holds them on the executors' disks between actions; what a
    lost executor held is computed again. ``keep="folder"`` writes each one
    once to the shared folder, so nothing is ever repeated. Without it they
    are plain lazy tables and Spark reuses exchanges within a single plan.

    ``fine`` is the same per channel, of the same messages: counts that add up
    over channels are then taken from it and not from the messages again, for
    all channels together (``by=()``) as for each name in lower case.
    """

    def __init__(self, df: DataFrame, catalog: DataFrame | None, by=(), keep: str | None = None, fine: Shared | None = None):
        if keep not in (None, "disk", "folder"):
            raise ValueError(f"unknown keep: {keep}")
        self.df, self.catalog, self.by = df, catalog, keys(by)
        self.fine, self._keep, self._made = fine, keep, {}

    def _once(self, name, make) -> DataFrame:
        if name not in self._made:
            made = make()
            if self._keep == "disk":
                made = made.persist(StorageLevel.DISK_ONLY)
            elif self._keep == "folder":
                made = checkpointed(made)
            self._made[name] = made
        return self._made[name]

    def _added_up(self, name: str, make, *counts: str) -> DataFrame:
        """``make()`` over the messages, or the sums of the counts of the finer table."""
        if self.fine is None:
            return self._once(name, make)
        rows = getattr(self.fine, name)
        if self.by:
            rows = rows.withColumn("channel", F.lower(F.trim("channel")))
        labels = [c for c in rows.columns if c not in counts and (self.by or c != "channel")]
        return self._once(name, lambda: rows.groupBy(*labels).agg(*(F.sum(c).alias(c) for c in counts)))

    @property
    def rollup(self):
        if self.fine is None:
            return self._once("rollup", lambda: act.activity(self.df, self.by))
        rows = self.fine.rollup
        # the roll-up has the channel either way; its readers sum rows that a change of case makes equal
        return rows.withColumn("channel", F.lower(F.trim("channel"))) if self.by else rows

    @property
    def bin_users(self):
        return self._added_up("bin_users", lambda: temporal.bin_users(self.df, self.by), "n")

    @property
    def bins(self):
        return self._once("bins", lambda: temporal.bins_of_users(self.bin_users, self.by))

    @property
    def daily(self):
        return self._once("daily", lambda: temporal.per_day(self.rollup, self.by))

    @property
    def emote_counts(self):
        return self._once("emote_counts", lambda: emotes.emote_counts(self.df, self.catalog, self.by, self.token_counts))

    @property
    def token_counts(self):
        return self._added_up("token_counts", lambda: emotes.token_counts(self.df, self.by), "uses")

    @property
    def native_counts(self):
        return self._once("native_counts", lambda: emotes.emote_counts(self.df, None, self.by, self.token_counts))

    @property
    def pair_counts(self):
        return self._added_up("pair_counts", lambda: emotes.pair_counts(self.df, self.by, C.MAX_EMOTES_PER_MSG), "uses")

    @property
    def word_counts(self):
        return self._once("word_counts", lambda: words.words_apart(self.token_counts, self.catalog, self.by))

    @property
    def command_counts(self):
        return self._once("command_counts", lambda: words.command_counts(self.df, self.by))

    @property
    def url_counts(self):
        return self._added_up("url_counts", lambda: links.url_counts(self.df, self.by), "uses")

    @property
    def edge_counts(self):
        return self._added_up("edge_counts", lambda: mentions.edge_counts(self.df, self.by), "uses")

    @property
    def reply_counts(self):
        return self._once("reply_counts", lambda: mentions.reply_counts(self.df, self.by))

    @property
    def text_counts(self):
        return self._added_up("text_counts", lambda: health.text_counts(self.df, self.by), "uses")

    @property
    def copy_paste(self):
        return self._once("copy_paste", lambda: health.copy_paste_events(self.df, self.by))

    def release(self):
        """Drop what was kept on disks."""
        if self._keep == "disk":
            for made in self._made.values():
                made.unpersist()
        self._made.clear()


def chat_stats(
    df: DataFrame,
    params: Params,
    catalog: DataFrame | None = None,
    by=(),
    all_urls: bool = True,
    language: Column | str | None = None,
    shared: Shared | None = None,
) -> dict[str, DataFrame]:
    """All selected sections; those on languages need a column that holds them. Nothing runs until a section is read, so unread sections cost nothing.

    The user filter comes first. ``by=("channel",)`` gives every section per
    channel in one pass instead of one run per channel.
    """
    by = keys(by)
    if params.user is not None:
        df = filter_user(df, params.user, params.user_id_type)
        shared = None
    s = shared or Shared(df, catalog, by)
    n = params.top_n

    def every(table: DataFrame, *zeros: str) -> DataFrame:
        """One row per key, also for keys the section found nothing for."""
        return complete(table, s.rollup, by, zeros)

    out = {
        "overview": overview.overview(df, by, s.rollup),
        "top_chatters": overview.top_chatters(s.rollup, n, params.on("engagement"), by),
        "chatter_quantiles": overview.chatter_quantiles(s.rollup, by),
        "active_chatters": overview.active_chatters(s.rollup, by),
        "hourly": temporal.hourly(s.rollup, by),
        "weekday_hour": temporal.weekday_hour(s.rollup, by),
        "per_day": s.daily,
        "peaks_5m": temporal.peaks_5m(s.bins, 3, by),
        "peak_concurrency": temporal.peak_concurrency(s.bins, by),
        "trend": temporal.trend(s.daily, by),
        "weekly_seasonality": temporal.weekly_seasonality(s.daily, by),
        "roles": roles.roles(s.rollup, by),
        "first_message_hours": temporal.first_message_hours(s.rollup, by),
        "top_emotes": top_k(s.emote_counts, params.top_emotes_n, [F.desc("uses"), F.asc("name")], by),
        "emote_diversity": emotes.emote_diversity(df, n, by),
        "top_words": words.top_words(s.word_counts, params.top_words_n, by),
        "vocabulary": every(words.vocabulary(s.word_counts, by), "unique_word_count"),
        "zipf_slope": every(words.zipf_slope(s.word_counts, by)),
        "non_ascii": health.non_ascii(df, by),
        "self_repetition": health.self_repetition(df, by),
        "warnings": health.checks(df, by, days=s.daily, hours=temporal.hourly(s.rollup, by)),
    }
    if params.on("staff_list"):
        out["staff_list"] = roles.staff_list(s.rollup, by)
    if params.on("subscriber_list"):
        out["subscriber_list"] = roles.subscriber_list(s.rollup, n * 10, by)
        out["subscriber_count"] = every(roles.subscriber_count(s.rollup, by), "subscriber_count")
    if params.on("emote_pairs"):
        out["emote_pairs"] = emotes.top_emote_pairs(s.pair_counts, n, by)
        out["emote_pairs_left_out"] = emotes.messages_above(df, C.MAX_EMOTES_PER_MSG, by)
    if params.on("emote_centrality"):
        out["emote_centrality"] = emotes.emote_centrality(s.pair_counts, n, by)
    if params.on("emote_entropy"):
        out["emote_entropy"] = every(emotes.emote_entropy(s.native_counts, by))
    if params.on("commands"):
        out["messages_with_commands"] = words.messages_with_commands(df, by)
        out["top_commands"] = words.top_commands(s.command_counts, n, by)
    if params.on("links"):
        out["messages_with_links"] = links.messages_with_links(df, by)
        out["top_domains"] = links.top_domains(s.url_counts, n, by)
        out["top_urls"] = links.top_urls(s.url_counts, n, by)
        out["unique_urls"] = every(links.unique_urls(s.url_counts, by), "unique_url_count")
        out["platform_links"] = every(links.platform_links(s.url_counts, by), *C.PLATFORM_RES, "other")
        if all_urls:
            out["all_urls"] = s.url_counts
    if params.on("mentions"):
        out["messages_with_mentions"] = mentions.messages_with_mentions(df, by)
        out["top_mentions"] = mentions.top_mentions(s.edge_counts, n, by)
        out["top_mention_pairs"] = mentions.top_mention_pairs(s.edge_counts, n, by)
    if params.on("mention_graph"):
        out["mention_graph"] = mentions.mention_graph(s.edge_counts, n, by)
    if params.on("mutual_mentions"):
        out["mutual_mentions"] = mentions.mutual_mentions(s.edge_counts, n, by)
    if params.on("duplicates"):
        out["duplicate_count"] = health.duplicate_count(s.text_counts, by)
        out["top_repeated"] = health.top_repeated(df, s.text_counts, n, by)
    if params.on("sessions"):
        out["sessions"] = sessions.sessions(df, params.session_gap_minutes, by)
    if params.on("concentration"):
        out["concentration"] = concentration.concentration(s.rollup, by)
    if params.on("lorenz"):
        out["lorenz"] = concentration.lorenz(s.rollup, by)
    if params.on("message_class"):
        out["message_classes"] = health.message_classes(df, catalog, by)
    if params.on("phrases") and params.top_phrases_n:
        out["top_phrases"] = words.top_phrases(df, params.top_phrases_n, by)
    if params.on("new_returning"):
        out["new_returning"] = temporal.new_returning(s.rollup, by)
    if params.on("anomalies"):
        out["anomalies"] = anomalies.anomalies(s.bins, params.anomaly_sigma, by, C.MAX_ANOMALIES)
    if params.on("language") and language is not None:
        out["language_breakdown"] = lang.language_breakdown(df, language, by)
        if params.on("language_by_day"):
            out["language_by_day"] = lang.language_by_day(df, language, by)
    if params.on("copy_paste_chains"):
        out["copy_paste_summary"] = every(
            health.copy_paste_summary(s.copy_paste, by), "cross_user_copy_paste_count", "cross_user_copy_paste_texts"
        )
        out["copy_paste_chains"] = health.top_copy_paste_chains(df, s.copy_paste, by=by)
    if params.on("length_trend"):
        out["length_trend"] = anomalies.length_trend(s.rollup, by)
    if params.on("cohort_retention"):
        out["cohort_retention"] = cohorts.cohort_retention(s.rollup, by, C.COHORT_MAX_WEEKS, C.COHORT_MAX_WEEKS)
    if params.on("bot_scores"):
        out["bot_scores"] = bots.bot_scores(df, by=by)
    if params.on("quote_replies"):
        out["quote_reply_count"] = every(mentions.quote_reply_count(s.reply_counts, by), "quote_reply_count")
        out["quote_reply_pairs"] = mentions.quote_reply_pairs(s.reply_counts, by=by)
    return out


def as_values(sections: dict[str, DataFrame]) -> DataFrame:
    """All sections as one long table: (section, key, value, n), n being how many rows hold the value.

    Numbers are given in thousandths, rounded, so that they compare; lists are joined by commas, null is ``(null)``.
    The sections are written one after the other into the shared folder, so the driver plans one at a time, however many there are;
    what they share is best kept (``Shared.keep``).
    """
    shape, path = "section string, key string, value string, n bigint", None
    for name, table in sections.items():
        cells = F.array(*[F.struct(F.lit(c).alias("key"), F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias("value")) for c in table.columns])
        rows = table.select(F.lit(name).alias("section"), F.inline(cells))
        number = F.when(F.col("value").rlike(r"^-?[0-9]+(\.[0-9]+)?([eE]-?[0-9]+)?$"), F.col("value").cast("double"))
        thousandths = F.floor(number * 1000 + 0.5).cast("bigint").cast("string")
        text = F.regexp_replace(F.regexp_replace("value", r"^\[|\]$", ""), ", ", ",")
        path = path or kept_path(table.sparkSession)
        counted = rows.groupBy("section", "key", F.coalesce(thousandths, text).alias("value")).agg(F.count("*").alias("n"))
        counted.write.mode("append").parquet(path)
        spark = table.sparkSession
    return spark.read.schema(shape).parquet(path)


def as_document(sections: dict[str, DataFrame]) -> DataFrame:
    """All sections as one table of (section, row as JSON)."""
    out = None
    for name, table in sections.items():
        rows = table.select(F.lit(name).alias("section"), F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"}).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out
