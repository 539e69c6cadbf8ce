"""Every query by name, over inputs that a session and a folder of tables provide."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley import constants as C
from parley.functions import text as tx
from parley.functions.core import time_cell
from parley.operators import anomalies, bots, browse, cohorts, concentration, emotes, filters, health, language
from parley.operators import links, mentions, overview, roles, sessions, temporal, words
from parley.plans import bundle, channels, compare, export
from parley.plans.run import report
from parley.plans.params import Params, default_sections, preset_sections
from parley.session import checkpointed, shared_folder
from parley.sources import catalog as cat
from parley.sources import coverage as cov
from parley.sources import records as rec
from parley.sources import sample, store
from parley.streaming import live

REGISTRY: dict[str, Callable] = {}
#: Sections that look at a catalog, which have queries per channel of their own, and a count that is zero here.
NAMED_SECTIONS = ("emote_pairs_left_out", "top_emotes", "top_words", "vocabulary", "zipf_slope", "message_classes")
CHANNELS = ("ch0", "ch1", "ch2")
CURRENT = (datetime(2024, 1, 16), datetime(2024, 1, 31))
PREVIOUS = (datetime(2024, 1, 1), datetime(2024, 1, 16))


def query(fn):
    """Register a function of the inputs under its own name."""
    REGISTRY[fn.__name__] = fn
    return fn


def listing() -> list[dict[str, str]]:
    """Names and descriptions of all queries."""
    return [{"name": name, "description": (fn.__doc__ or "").strip()} for name, fn in REGISTRY.items()]


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """One registered query over the tables of a folder."""
    return REGISTRY[name](Inputs(spark, folder))


class Inputs:
    """Tables the registered queries read. ``stored`` names a Parquet copy of the derived messages."""

    def __init__(self, spark: SparkSession, folder: str, stored: str | None = None):
        self.spark, self.folder, self.stored = spark, folder, stored

    def table(self, name: str) -> DataFrame:
        return sample.table(self.spark, self.folder, name)

    @cached_property
    def with_lang(self) -> DataFrame:
        if self.stored:
            return self.spark.read.parquet(self.stored)
        return sample.messages(self.spark, self.folder, keep=("lang",))

    @property
    def messages(self) -> DataFrame:
        return self.with_lang.drop("lang")

    @cached_property
    def kept_messages(self) -> DataFrame:
        """The messages, derived once for queries of many sections."""
        return self.messages if self.stored else checkpointed(self.messages)

    def shared(self) -> bundle.Shared:
        """What the sections of a run over ``kept_messages`` share, each part made once."""
        return bundle.Shared(self.kept_messages, self.names, keep="folder")

    @cached_property
    def records(self) -> DataFrame:
        return sample.records(self.spark, self.folder)

    @cached_property
    def tagged(self) -> DataFrame:
        """Messages that still carry their tags."""
        return rec.normalize_messages(self.records, keep=("tags",))

    @cached_property
    def catalog(self) -> DataFrame:
        """Emote names per channel: every token of the benchmark texts, and five that are used in chat."""
        items = self.table("benchmark")
        tokens = items.select(
            F.concat(F.lit("ch"), (F.col("item_id") % 3).cast("string")).alias("channel"),
            F.explode(F.array_distinct(tx.emote_tokens("text"))).alias("name"),
        )
        usual = F.array(*[F.lit(n) for n in ("Kappa", "WHAT", "THIS", "Raid", "incoming")])
        spoken = items.select(
            F.concat(F.lit("ch"), (F.col("item_id") % 3).cast("string")).alias("channel"), F.explode(usual).alias("name")
        )
        return tokens.unionByName(spoken).distinct().withColumn("emote_id", F.concat(F.lit("e-"), "name"))

    @cached_property
    def names(self) -> DataFrame:
        """The catalog of all channels together."""
        return cat.catalog_union(self.catalog, CHANNELS)

    @cached_property
    def both(self) -> DataFrame:
        return compare.label_periods(self.messages, CURRENT, PREVIOUS)

    @cached_property
    def kept_both(self) -> DataFrame:
        """The same from messages that are derived once."""
        return compare.label_periods(self.kept_messages, CURRENT, PREVIOUS)

    def params(self, preset: str | None = None, **changes) -> Params:
        sections = preset_sections(preset) if preset else default_sections()
        return Params(*CURRENT, channels=CHANNELS, **{"sections": sections, **changes})

    def scratch(self, name: str) -> str:
        return f"{shared_folder(self.spark)}/parley-{name}-{uuid.uuid4().hex}"


# --- totals and users ---------------------------------------------------------------------------


@query
def overview_totals(i):
    return overview.overview(i.messages).withColumns({c: F.round(c, 6) for c in ("avg_message_length", "avg_words_per_message")})


@query
def overview_per_channel(i):
    t = overview.overview(i.messages, "channel")
    return t.withColumns({c: F.round(c, 6) for c in ("avg_message_length", "avg_words_per_message")})


@query
def top_chatters(i):
    top = overview.top_chatters(i.messages, 20)
    return top.withColumn("channels", F.concat_ws(",", "channels")).withColumn("avg_length", F.round("avg_length", 6))


@query
def top_chatters_per_channel(i):
    top = overview.top_chatters(i.messages, 5, by="channel")
    return top.withColumn("avg_length", F.round("avg_length", 6))


@query
def chatter_quantiles(i):
    return overview.chatter_quantiles(i.messages)


@query
def active_chatters(i):
    return overview.active_chatters(i.messages).withColumn("avg_active_chatters", F.round("avg_active_chatters", 6))


@query
def roles_seen(i):
    return roles.roles(i.messages)


@query
def staff_list(i):
    return roles.staff_list(i.messages)


@query
def subscriber_list(i):
    return roles.subscriber_list(i.messages, 200)


@query
def subscriber_count(i):
    return roles.subscriber_count(i.messages)


# --- time ---------------------------------------------------------------------------------------


@query
def hourly(i):
    return temporal.hourly(i.messages)


@query
def hourly_per_channel(i):
    return temporal.hourly(i.messages, "channel")


@query
def weekday_hour(i):
    return temporal.weekday_hour(i.messages)


@query
def per_day(i):
    return temporal.per_day(i.messages)


@query
def bins_5m(i):
    return temporal.bins_5m(i.messages)


@query
def peaks_5m(i):
    return temporal.peaks_5m(temporal.bins_5m(i.messages), 3)


@query
def peak_concurrency(i):
    return temporal.peak_concurrency(temporal.bins_5m(i.messages))


@query
def trend(i):
    return temporal.trend(temporal.per_day(i.messages))


@query
def weekly_seasonality(i):
    return temporal.weekly_seasonality(temporal.per_day(i.messages))


@query
def first_message_hours(i):
    return temporal.first_message_hours(i.messages)


@query
def new_returning(i):
    return temporal.new_returning(i.messages)


@query
def session_table(i):
    return sessions.session_table(i.messages, 120).drop("session_no")


@query
def session_summary(i):
    t = sessions.sessions(i.messages, 120)
    return t.withColumns(
        {c: F.round(c, 6) for c in ("avg_messages_per_session", "avg_session_minutes", "longest_session_minutes")}
    )


@query
def concentration_of_users(i):
    return concentration.concentration(i.messages)


@query
def lorenz(i):
    return concentration.lorenz(i.messages)


@query
def anomalies_5m(i):
    return anomalies.anomalies(temporal.bins_5m(i.messages), 3.0)


@query
def length_trend(i):
    return anomalies.length_trend(i.messages)


@query
def cohort_retention(i):
    return cohorts.cohort_retention(i.messages)


@query
def gap_statistics(i):
    return bots.gap_statistics(i.messages).withColumn("gap_std", F.round("gap_std", 4))


@query
def bot_scores(i):
    return bots.bot_scores(i.messages).withColumn("signals", F.concat_ws(",", "signals"))


# --- emotes and words ---------------------------------------------------------------------------


@query
def top_emotes(i):
    return emotes.top_emotes(i.messages, i.names, 50)


@query
def top_emotes_per_channel(i):
    return emotes.top_emotes(i.messages, i.catalog, 5, "channel")


@query
def emote_pairs(i):
    return emotes.top_emote_pairs(emotes.pair_counts(i.messages), 20)


@query
def emote_centrality(i):
    return emotes.emote_centrality(emotes.pair_counts(i.messages), 20)


@query
def emote_entropy(i):
    return emotes.emote_entropy(emotes.native_counts(i.messages))


@query
def emote_diversity(i):
    return emotes.emote_diversity(i.messages, 20)


@query
def top_words(i):
    return words.top_words(words.words_apart(emotes.token_counts(i.messages), i.names), 50)


@query
def top_words_per_channel(i):
    return words.top_words(words.word_counts(i.messages, i.catalog, "channel"), 10, "channel")


@query
def vocabulary(i):
    return words.vocabulary(words.words_apart(emotes.token_counts(i.messages), i.names))


@query
def zipf_slope(i):
    return words.zipf_slope(words.words_apart(emotes.token_counts(i.messages), i.names))


@query
def top_commands(i):
    return words.top_commands(words.command_counts(i.messages), 20)


@query
def messages_with_commands(i):
    return words.messages_with_commands(i.messages)


@query
def top_phrases(i):
    return words.top_phrases(i.messages, 50)


# --- links and mentions -------------------------------------------------------------------------


@query
def top_urls(i):
    return links.top_urls(links.url_counts(i.messages), 20)


@query
def all_urls(i):
    return links.url_counts(i.messages)


@query
def link_totals(i):
    counts = links.unique_urls(links.url_counts(i.messages))
    total = links.messages_with_links(i.messages)
    return total.withColumn("unique_url_count", counts.scalar())


@query
def top_domains(i):
    return links.top_domains(links.url_counts(i.messages), 20)


@query
def platform_links(i):
    return links.platform_links(_platform_urls(i))


@query
def platform_links_strict(i):
    return links.platform_links(_platform_urls(i), strict=True)


def _platform_urls(i):
    """Links of the messages, and page addresses moved to the hosts of platforms by page number."""
    hosts = ("www.youtube.com", "clips.twitch.tv", "discord.gg", "x.com", "netflix.com", "kick.com", "youtu.be", "plain.org")
    host = F.element_at(F.array(*[F.lit(h) for h in hosts]), (F.col("page_id") % len(hosts) + 1).cast("int"))
    moved = i.table("pages").select(F.regexp_replace("url", F.lit("//[^/]+"), F.concat(F.lit("//"), host)).alias("text"))
    return links.url_counts(i.messages.select("text").unionByName(moved))


@query
def messages_with_mentions(i):
    return mentions.messages_with_mentions(i.messages)


@query
def top_mentions(i):
    return mentions.top_mentions(mentions.edge_counts(i.messages), 20)


@query
def top_mention_pairs(i):
    return mentions.top_mention_pairs(mentions.edge_counts(i.messages), 20)


@query
def mention_graph(i):
    return mentions.mention_graph(mentions.edge_counts(i.messages), 20)


@query
def mutual_mentions(i):
    return mentions.mutual_mentions(mentions.edge_counts(i.messages), 20)


@query
def replies(i):
    return mentions.replies(i.messages)


@query
def replies_within_a_day(i):
    return mentions.replies(i.messages, window_s=86_400)


@query
def quote_reply_pairs(i):
    return mentions.quote_reply_pairs(mentions.reply_counts(i.messages))


@query
def quote_reply_count(i):
    return mentions.quote_reply_count(mentions.reply_counts(i.messages))


# --- health and language ------------------------------------------------------------------------


@query
def duplicate_count(i):
    return health.duplicate_count(health.text_counts(i.messages))


@query
def top_repeated(i):
    return health.top_repeated(i.messages, health.text_counts(i.messages), 20)


@query
def self_repetition(i):
    return health.self_repetition(i.messages)


@query
def self_repetition_per_channel(i):
    return health.self_repetition(i.messages, "channel")


@query
def copy_paste_summary(i):
    return health.copy_paste_summary(health.copy_paste_events(i.messages))


@query
def copy_paste_chains(i):
    return health.top_copy_paste_chains(i.messages, health.copy_paste_events(i.messages))


@query
def copy_paste_chains_slow(i):
    return health.top_copy_paste_chains(i.messages, health.copy_paste_events(i.messages, window_s=7200), 50)


@query
def non_ascii(i):
    return health.non_ascii(i.messages)


@query
def message_classes(i):
    return health.message_classes(i.messages, i.names)


@query
def message_classes_by_join(i):
    return health.message_classes(i.messages, i.names)


@query
def message_classes_per_channel(i):
    return health.message_classes(i.messages, i.catalog, "channel")


@query
def data_checks(i):
    return health.checks(i.messages)


@query
def arrival_checks(i):
    """Arrival number from the message id: time then never goes back."""
    numbered = i.messages.withColumn("arrival", F.substr("id", F.lit(2)).cast("bigint"))
    return health.checks(numbered, arrival="arrival")


@query
def broken_tables(i):
    """The checks over a table of days that misses one and a table of hours that counts one message twice."""
    days = temporal.per_day(i.messages).filter(F.col("day") != F.lit("2024-01-10").cast("date"))
    hours = temporal.hourly(i.messages).withColumn("messages", F.col("messages") + (F.col("hour") == 5).cast("int"))
    return health.checks(i.messages, days=days, hours=hours)


@query
def language_breakdown(i):
    return language.language_breakdown(i.with_lang, "lang")


@query
def language_by_day(i):
    return language.language_by_day(i.with_lang, "lang")


# --- several sections, channels, periods --------------------------------------------------------


@query
def chat_stats(i):
    """Every value of every section of a quick run."""
    return bundle.as_values(bundle.chat_stats(i.kept_messages, i.params("quick"), i.names, shared=i.shared()))


@query
def chat_stats_sizes(i):
    """Rows of each section of a quick run."""
    out = None
    for name, table in bundle.chat_stats(i.kept_messages, i.params("quick"), i.names, shared=i.shared()).items():
        size = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n")
        out = size if out is None else out.unionByName(size)
    return out


@query
def chat_stats_of_user(i):
    """Totals and days of one user, after the user filter."""
    found = bundle.chat_stats(i.messages, i.params(user=" uSER7 "), i.names)
    return found["per_day"].withColumn("total_messages", found["overview"].select("total_messages").scalar())


@query
def per_channel_hours(i):
    return channels.per_channel(i.messages, i.params("quick"), i.catalog)["weekday_hour"]


@query
def per_channel_all(i):
    """Every value of the sections that do not look at names, for a channel with messages and one without."""
    params = Params(*CURRENT, channels=("CH1", "ghost"), sections=preset_sections("quick"))
    found = channels.per_channel(i.kept_messages, params, keep="folder")
    wide = [*channels.SLOTS, *(n for n in channels.ONE_ROW if n not in {"vocabulary", "zipf_slope", "message_classes"})]
    return bundle.as_values({n: found[n] for n in wide if n in found})


@query
def per_channel_every(i):
    """Every value of all sections that need no catalog, for all channels, from one count of the messages per channel."""
    params = Params(*CURRENT, channels=("CH0", "ch1", " Ch2 "), sections=preset_sections("everything"), top_phrases_n=50)
    fine = bundle.Shared(i.kept_messages, None, channels.BY, keep="folder")
    found = channels.per_channel(i.kept_messages, params, None, keep="folder", fine=fine)
    return bundle.as_values({n: t for n, t in found.items() if n not in NAMED_SECTIONS})


@query
def channel_totals(i):
    return channels.channel_totals(i.messages, [*CHANNELS, "ghost"])


@query
def channel_days(i):
    return channels.aligned_days(i.messages, [*CHANNELS, "ghost"])


@query
def channel_commands(i):
    return channels.channel_summaries(i.messages, CHANNELS, i.catalog)["top_commands"]


@query
def channel_domains(i):
    return channels.channel_summaries(i.messages, CHANNELS, i.catalog)["top_domains"]


@query
def channel_mentions(i):
    return channels.channel_summaries(i.messages, CHANNELS, i.catalog)["top_mentions"]


@query
def channel_roles(i):
    return channels.channel_summaries(i.messages, CHANNELS, i.catalog)["roles"]


@query
def channel_share(i):
    return channels.channel_share(channels.channel_totals(i.messages, CHANNELS))


@query
def reconcile(i):
    totals = channels.channel_totals(i.messages, [*CHANNELS, "ghost"])
    pooled = i.messages.agg(F.count("*").alias("total_messages"))
    return channels.reconcile(totals, pooled, cov.clamp_to_calendar(_needs(i), i.messages))


@query
def period_overview(i):
    t = compare.period_metrics(i.both, i.names)["overview"]
    return t.withColumns({c: F.round(c, 6) for c in ("avg_message_length", "avg_words_per_message")})


@query
def period_hours(i):
    return compare.period_metrics(i.both, i.names)["hourly"]


@query
def top_movers(i):
    return compare.top_movers(i.both)


@query
def comparison_table(i):
    return compare.comparison_table(i.kept_both, i.names)


@query
def headline_table(i):
    table = compare.headline_table(i.both, i.names)
    return table.withColumns({c: F.round(c, 6) for c in ("current", "previous")})


@query
def overlay_days(i):
    return compare.overlay(i.both)


@query
def summary_text(i):
    return export.summary_text(bundle.chat_stats(i.messages, i.params("quick"), i.names), "ch0+ch1+ch2", *CURRENT)


@query
def exported_sections(i):
    """All sections of the CSV export written in one pass and read back: every cell but p-values, and lines that follow the order."""
    root = i.scratch("csv")
    made = bundle.chat_stats(i.kept_messages, i.params("everything"), i.names, shared=i.shared())
    names = export.write_sections(made, root, "all")
    read = {n: export.read_section(i.spark, root, n, "all") for n in names}
    return bundle.as_values({n: t.drop("p_value") for n, t in read.items()})


@query
def message_lines(i):
    return export.message_lines(filters.filter_messages(i.tagged, command=True)).withColumnRenamed("value", "line")


# --- filters ------------------------------------------------------------------------------------


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("channel").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query
def filter_window(i):
    return _counted(filters.slice_window(i.messages, datetime(2024, 1, 10), datetime(2024, 1, 12, 12)))


@query
def filter_user_login(i):
    return _counted(filters.filter_user(i.messages, " uSER7 "))


@query
def filter_user_id(i):
    return _counted(filters.filter_user(i.messages, "7", "userid"))


@query
def filter_one_channel(i):
    return _counted(filters.filter_channel(i.messages, "ch1"))


@query
def filter_text(i):
    return _counted(filters.filter_messages(i.tagged, text=" THE "))


@query
def filter_username(i):
    return _counted(filters.filter_messages(i.tagged, username="user1"))


@query
def filter_length(i):
    return _counted(filters.filter_messages(i.tagged, min_length=19, max_length=400))


@query
def filter_combined(i):
    return _counted(filters.filter_messages(i.tagged, text="e", url=True, number=True, min_length=10))


@query
def predicate_counts(i):
    """Messages passing each yes/no predicate."""
    tests = {name: make() for name, make in filters.FLAGS.items()}
    return i.tagged.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])


@query
def message_tag_counts(i):
    labels = F.array_join(filters.message_tags(), ",").alias("labels")
    return i.tagged.groupBy(labels).agg(F.count("*").alias("n"))


# --- scalar functions ---------------------------------------------------------------------------


@query
def cleaned_text(i):
    text = tx.clean_text("text")
    return i.messages.select("id", F.md5(text.cast("binary")).alias("cleaned"), F.length(text).alias("chars"))


@query
def parsed_emotes(i):
    return i.messages.select("id", F.concat_ws("|", tx.parse_emotes("emotes_tag", "text")).alias("emotes"))


@query
def url_parts(i):
    """Page addresses with noise around them: normalised form and domain."""
    noise = F.element_at(F.array(*[F.lit(x) for x in ("", "?", "/.", "!)", "//")]), (F.col("page_id") % 5 + 1).cast("int"))
    url = tx.normalize_url(F.concat(F.regexp_replace("url", "example", "EXAMPLE"), noise))
    return i.table("pages").select("page_id", url.alias("url"), tx.domain_of(url).alias("domain"))


@query
def character_counts(i):
    """Letters, capitals, other characters and blank-stripped length of whole documents."""
    return i.table("documents").select(
        "doc_id",
        tx.char_len("text").alias("chars"),
        tx.letters("text").alias("letters"),
        tx.capitals("text").alias("capitals"),
        tx.non_ascii_chars("text").alias("non_ascii"),
        tx.char_len(tx.strip_end(F.concat("text", F.lit(" \n\t")))).alias("stripped"),
        tx.char_len(tx.ellipsis("text")).alias("shown"),
        F.size(tx.words("text")).cast("bigint").alias("words"),
        F.size(tx.emote_tokens("text")).cast("bigint").alias("tokens"),
    )


@query
def calendar_parts(i):
    """Day, hour, weekday, Monday and 5-minute bin of each event."""
    return i.table("events").select(
        "event_id",
        F.to_date("ts").alias("day"),
        F.hour("ts").alias("hour"),
        F.weekday("ts").alias("weekday"),
        F.date_sub(F.to_date("ts"), F.weekday("ts")).alias("monday"),
        time_cell("ts", "5 minutes").alias("bin"),
        tx.iso_ts("ts").alias("iso"),
    )


@query
def poisson_tails(i):
    """Upper and lower tail of each distinct bin count under the mean bin count."""
    from parley.functions.stats import poisson_tail

    bins = temporal.bins_5m(i.messages)
    counts = bins.select(F.col("message_count").alias("k")).distinct()
    mean = bins.agg(F.avg("message_count")).scalar()
    rows = counts.withColumn("lam", mean)
    return rows.select(
        "k",
        F.round(poisson_tail("k", "lam", F.lit(True)), 6).alias("upper"),
        F.round(poisson_tail("k", "lam", F.lit(False)), 6).alias("lower"),
    )


# --- log browser --------------------------------------------------------------------------------


@query
def list_channels(i):
    return browse.list_channels(i.messages)


@query
def available_days(i):
    return browse.available_days(i.messages)


@query
def name_history(i):
    return browse.name_history(i.messages, "7")


@query
def user_stats(i):
    return browse.user_stats(i.messages, "ch1", "user7", start=CURRENT[0], end=CURRENT[1])


@query
def channel_stats(i):
    return browse.channel_stats(i.messages, "ch1", *CURRENT)


@query
def channel_top_chatters(i):
    return browse.channel_top_chatters(i.messages, "ch1")


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("id", "ts", "username", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def search_user(i):
    return _shown(browse.search(i.messages, "ch1", "7", "the", "userid", limit=20))


@query
def channel_logs(i):
    return _shown(browse.channel_logs(i.messages, "ch0", *CURRENT, limit=100, offset=30))


@query
def channel_logs_deep(i):
    return _shown(browse.channel_logs(i.messages, "ch0", limit=100, offset=1500, reverse=True))


@query
def user_logs(i):
    return _shown(browse.user_logs(i.messages, "ch1", "user7", limit=25, reverse=True))


@query
def channel_logs_on(i):
    return _shown(browse.channel_logs_on(i.messages, "ch2", "2024-01-12", limit=1000))


@query
def user_logs_in(i):
    return _shown(browse.user_logs_in(i.messages, "ch1", "7", "2024-01", "userid", limit=1000))


@query
def random_channel(i):
    return _shown(browse.random_channel(i.messages, "ch1", 10, seed=42))


@query
def random_user(i):
    return _shown(browse.random_user(i.messages, "ch1", "7", "userid", 5, seed=42))


@query
def merged_pages(i):
    """Two overlapping stretches of the log, some without id, put together."""
    rows = i.messages.withColumn("id", F.when(F.col("user_id") != "5", F.col("id")))
    first = rows.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    second = rows.filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    return _shown(browse.merge_pages(first, second))


@query
def random_without_ids(i):
    """A draw from messages of which every third has no id."""
    rows = i.messages.withColumn("id", F.when(F.substr("id", F.lit(2)).cast("bigint") % 3 != 0, F.col("id")))
    return _shown(browse.random_channel(rows, " CH2 ", 20, seed=7))


@query
def suggest_channels(i):
    return browse.suggest_channels(i.messages, "CH", taken=["CH1"])


# --- sources and store --------------------------------------------------------------------------


@query
def parsed_records(i):
    """Raw records written as JSON text and read back, with unreadable lines between them."""
    lines = i.records.select(F.to_json(F.struct(*i.records.columns)).alias("value"))
    noise = i.table("documents").select(F.col("text").alias("value"))
    return _counted(rec.parse_records(lines.unionByName(noise)))


@query
def normalized_messages(i):
    rows = rec.normalize_messages(i.records)
    return rows.select("id", "ts", "user_id", "username", "emotes_tag", "role", "channel", F.length("text").alias("chars"))


@query
def room_ids(i):
    return rec.room_id(i.records)


@query
def deduplicated(i):
    """The messages with a changed second copy of one user's rows and rows without id."""
    changed = i.messages.filter(F.col("user_id") == "3").withColumn("text", F.lit("edited"))
    no_id = i.messages.filter(F.col("user_id") == "4").withColumn("id", F.lit(None).cast("string"))
    every = i.messages.withColumn("n", F.lit(0)).unionByName(changed.withColumn("n", F.lit(1)))
    rows = rec.dedupe_by_id(every.unionByName(no_id.withColumn("n", F.lit(2))), [F.col("n")])
    return rows.groupBy("user_id").agg(F.count("*").alias("rows"), F.count_if(F.col("text") == "edited").alias("edited"))


@query
def pooled_channels(i):
    parts = {c: i.messages.filter(F.col("channel") == c).drop("channel") for c in CHANNELS}
    return _counted(rec.pool_channels(parts))


@query
def channel_keys(i):
    named = F.concat(F.lit(" "), "source", F.lit("-É "), "lang")
    return i.table("documents").select(tx.channel_key(named).alias("channel_key")).distinct()


@query
def stored_months(i):
    """Two overlapping merges into a new store, then a range read back."""
    root = i.scratch("store")
    cut = lambda a, b: filters.slice_window(i.messages, a, b)
    store.merge_store(i.spark, root, cut("2024-01-01", "2024-01-20"))
    store.merge_store(i.spark, root, cut("2024-01-15", "2024-02-01"))
    return _counted(store.read_store(i.spark, root, ["CH0", "ch2"], datetime(2024, 1, 5), datetime(2024, 1, 28)))


@query
def merged_last_arrival(i):
    """A store after merges in which an id comes several times at one time; the last arrived copy stays."""
    root = i.scratch("arrivals")
    rows = i.messages.withColumn("came", F.lit(1))
    again = rows.withColumn("text", F.concat(F.lit("zzz "), "role")).withColumn("came", F.lit(2))
    last = rows.withColumn("text", F.concat(F.lit("aaa "), "role")).withColumn("came", F.lit(3))
    store.merge_store(i.spark, root, filters.slice_window(rows, "2024-01-01", "2024-01-10"), arrival="came")
    store.merge_store(i.spark, root, last.unionByName(rows).unionByName(again), arrival="came")
    found = store.read_store(i.spark, root, CHANNELS, datetime(2024, 1, 1), datetime(2025, 1, 1))
    return found.groupBy("channel", "text").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query
def raw_files(i):
    """Records written as lines, every tenth one broken, and read back: per channel, and the lines that are none."""
    path = i.scratch("lines")
    lines = i.records.withColumn("line", F.to_json(F.struct(*i.records.columns)))
    broken = F.substr("id", F.lit(2)).cast("bigint") % 10 == 3
    lines.select(F.when(broken, F.left("line", F.lit(40))).otherwise(F.col("line")).alias("value")).write.text(path)
    good = rec.read_messages(i.spark, path).groupBy("channel").agg(F.count("*").alias("n"))
    bad = rec.unreadable_lines(i.spark, path).agg(F.count("*").alias("n")).select(F.lit("unreadable").alias("channel"), "n")
    return good.unionByName(bad)


@query
def run_any_case(i):
    """The totals of a whole run for a channel whose name is written in another case."""
    parts = report(i.messages, Params(*CURRENT, channels=(" CH0 ",)))
    totals = parts["pooled"]["overview"]
    return totals.withColumns({c: F.round(c, 6) for c in ("avg_message_length", "avg_words_per_message")})


def _bins_as_intervals(i, minutes: int) -> DataFrame:
    start = time_cell("ts", f"{minutes} minutes")
    return i.messages.select(F.col("channel"), start.alias("cov_from")).distinct().withColumn(
        "cov_to", F.col("cov_from") + F.expr(f"interval {minutes} minutes")
    )


def _needs(i) -> DataFrame:
    """Per channel, from before its first to after its last day; channel 2 asks for a later year."""
    later = F.when(F.col("channel") == "ch2", F.expr("interval 400 days")).otherwise(F.expr("interval 0 days"))
    return i.messages.groupBy("channel").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(
        "channel",
        (F.date_trunc("day", "a").cast("timestamp_ntz") - F.expr("interval 3 days") + later).alias("need_from"),
        (F.date_trunc("day", "b").cast("timestamp_ntz") + F.expr("interval 40 days") + later).alias("need_to"),
    )


def _inner_needs(i) -> DataFrame:
    """Per channel, the middle of its history."""
    return i.messages.groupBy("channel").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(
        "channel",
        (F.date_trunc("day", "a").cast("timestamp_ntz") + F.expr("interval 2 days")).alias("need_from"),
        (F.date_trunc("day", "b").cast("timestamp_ntz") - F.expr("interval 2 days")).alias("need_to"),
    )


@query
def months_touched(i):
    return cov.months_in(_needs(i), "channel").select("channel", "year_month", "month_start", "month_end")


@query
def coverage_merged(i):
    return cov.merge(_bins_as_intervals(i, 30), "channel")


@query
def coverage_gaps(i):
    return cov.gaps(_bins_as_intervals(i, 30), _inner_needs(i), "channel")


@query
def coverage_tests(i):
    """Whether each day of each channel is covered by a single stretch of stored hours."""
    days = i.messages.select("channel", F.to_date("ts").alias("day")).distinct()
    needs = days.select(
        "channel",
        F.date_format("day", "dd").alias("d"),
        F.col("day").cast("timestamp_ntz").alias("need_from"),
        (F.col("day") + 1).cast("timestamp_ntz").alias("need_to"),
    )
    spans = _bins_as_intervals(i, 120).join(needs.select("channel", "d"), "channel")
    return cov.covers(spans, needs, ["channel", "d"])


def _fetched(i) -> DataFrame:
    """One download per channel and day; every third day was cut off."""
    day = F.to_date("ts")
    return i.messages.groupBy("channel", day.alias("day")).agg(F.max("ts").alias("max_ts")).select(
        "channel",
        F.col("day").cast("timestamp_ntz").alias("span_from"),
        (F.col("day") + 1).cast("timestamp_ntz").alias("span_to"),
        (F.dayofmonth("day") % 3 == 0).alias("truncated"),
        "max_ts",
    )


@query
def coverage_after_fetch(i):
    return cov.merge(cov.after_fetch(_fetched(i), "channel"), "channel")


@query
def refresh_plan(i):
    needs = _inner_needs(i).withColumns(
        {
            "fetched_at": F.when(F.col("channel") != "ch2", F.col("need_to") - F.expr("interval 5 days")),
            "stale": F.col("channel") == "ch0",
        }
    )
    return cov.refresh_plan(_bins_as_intervals(i, 60), needs, by="channel")


def _months(i) -> DataFrame:
    by_month = i.messages.groupBy("channel", F.date_format("ts", "yyyy_MM").alias("m")).agg(F.max("ts").alias("fetched_at"))
    start = F.to_timestamp_ntz(F.concat(F.replace("m", F.lit("_"), F.lit("-")), F.lit("-01 00:00:00")))
    return by_month.select(
        "channel",
        "fetched_at",
        start.alias("month_start"),
        (start + F.expr("interval 1 month")).alias("month_end"),
        (F.col("channel") == "ch1").alias("truncated"),
        F.lit(True).alias("covered"),
    )


@query
def month_states(i):
    now = F.lit("2024-01-31 00:15:00").cast("timestamp_ntz")
    return cov.month_state(_months(i), now).select("channel", "immutable", "stale", "complete")


@query
def clamped_needs(i):
    return cov.clamp_to_calendar(_needs(i), i.messages)


@query
def run_metadata(i):
    return cov.run_metadata(_months(i).withColumn("fetched", F.lit(False)))


def _payloads(i) -> DataFrame:
    """One provider answer per part, in the shape of its provider."""
    part = i.table("part")
    key, place = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    shared = F.concat(F.lit("s"), (F.col("p_partkey") % 50).cast("string"))
    first = F.struct(key.alias("id"), F.col("p_name").alias("name"))
    second = F.struct(shared.alias("id"), F.col("p_brand").alias("name"))
    coded = lambda s: F.struct(s["id"].alias("id"), s["name"].alias("code"))
    seventv = F.to_json(F.struct(F.struct(F.array(first, second).alias("emotes")).alias("emote_set")))
    bttv = F.to_json(
        F.struct(F.array(coded(first)).alias("channelEmotes"), F.array(coded(second)).alias("sharedEmotes"))
    )
    ffz = F.to_json(F.struct(F.create_map(F.lit("1"), F.struct(F.array(first, second).alias("emoticons"))).alias("sets")))
    return part.select(
        F.concat(F.lit("ch"), (F.col("p_size") % 3).cast("string")).alias("channel"),
        F.element_at(F.array(*[F.lit(p) for p in cat.PROVIDERS]), (place + 1).cast("int")).alias("provider"),
        F.when(place == 0, seventv).when(place == 1, bttv).otherwise(ffz).alias("payload"),
    )


@query
def emote_catalog(i):
    """Catalogs of three providers, with ids that several answers name differently."""
    made = cat.emote_catalog(_payloads(i))
    return made.select("channel", "emote_id", "provider", "name")


@query
def emote_catalog_union(i):
    renamed = i.catalog.withColumn("name", F.concat("name", F.lit("@"), "channel"))
    return cat.catalog_union(renamed, ["ch2", "ch0", "ch1"])


# --- streaming ----------------------------------------------------------------------------------


def _stream(i) -> DataFrame:
    """The events file as a stream of messages."""
    schema = i.table("events").schema
    events = i.spark.readStream.schema(schema).parquet(f"{i.folder.rstrip('/')}/events.parquet*")
    user = F.col("user_id").cast("string")
    return events.select(
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        user.alias("user_id"),
        F.concat(F.lit("User"), user).alias("username"),
        F.concat_ws(" ", "event_type", "props").alias("text"),
        F.lit(None).cast("string").alias("emotes_tag"),
        F.lit("regular").alias("role"),
        F.concat(F.lit("ch"), (F.col("user_id") % 3).cast("string")).alias("channel"),
    )


@query
def live_bins(i):
    """Messages and users of every 5-minute bin of a stream."""
    root = i.scratch("bins")
    live.write_bins(_stream(i), f"{root}/data", f"{root}/checkpoint").awaitTermination()
    return live.read_bins(i.spark, f"{root}/data")


@query
def live_sessions(i):
    """All sessions of a stream, those that are still open included."""
    root = i.scratch("sessions")
    live.write_sessions(_stream(i), f"{root}/data", f"{root}/checkpoint", 120).awaitTermination()
    return live.read_sessions(i.spark, f"{root}/data", 120).drop("session_no")


@query
def ingest_stream(i):
    """A store that a stream was merged into, every message sent twice with another text: the last stays."""
    root = i.scratch("ingest")
    copy = F.explode(F.array(F.lit(1), F.lit(2)))
    twice = _stream(i).withColumn("came", copy).withColumn("text", F.concat_ws(" ", "text", "came"))
    live.ingest_into_store(twice, f"{root}/store", f"{root}/checkpoint", arrival="came").awaitTermination()
    rows = store.scan(i.spark, f"{root}/store")
    last = F.count_if(F.endswith("text", F.lit(" 2"))).alias("second")
    digest = F.sum(F.length("text")).alias("chars")
    return rows.groupBy("channel_key", "year_month").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), last, digest)


@query
def stored_page(i):
    """A deep page of a stored channel, found by the counts that the merges keep."""
    root = i.scratch("pages")
    store.merge_store(i.spark, root, filters.slice_window(i.messages, "2024-01-01", "2024-01-12"))
    store.merge_store(i.spark, root, filters.slice_window(i.messages, "2024-01-10", "2024-02-01"))
    return _shown(browse.stored_page(i.spark, root, "ch0", limit=100, offset=1500, reverse=True))
