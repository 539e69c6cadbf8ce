"""Duplicates, repetition, copy-paste chains, character mix and message classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley import constants as C
from parley.functions import text as tx
from parley.functions.core import attach, keys, seconds_between, time_cell, top_k
from parley.operators import temporal
from parley.operators.activity import activity
from parley.operators.emotes import native_counts


def text_counts(df: DataFrame, by=()) -> DataFrame:
    """Uses per exact text, which is known by its 256-bit hash: texts themselves are not shuffled."""
    by = keys(by)
    return df.groupBy(*by, tx.text_key("text").alias("text_key")).agg(F.count("*").alias("uses"))


def with_texts(top: DataFrame, df: DataFrame, by=()) -> DataFrame:
    """The texts of a short report, looked up by their hash.

    The report has a few rows per key and goes to all tasks, so texts are not shuffled to be looked up.
    """
    by = keys(by)
    wanted = df.select(*by, tx.text_key("text").alias("text_key"), "text").join(
        F.broadcast(top.select(*by, "text_key")), [*by, "text_key"], "left_semi"
    )
    texts = wanted.groupBy(*by, "text_key").agg(F.first("text").alias("text"))
    return top.join(texts, [*by, "text_key"])


def duplicate_count(counts: DataFrame, by=()) -> DataFrame:
    """Messages beyond the first use of their text."""
    return counts.groupBy(*keys(by)).agg(
        F.coalesce(F.sum(F.col("uses") - 1), F.lit(0)).alias("duplicate_message_count")
    )


def top_repeated(df: DataFrame, counts: DataFrame, n: int = 20, by=()) -> DataFrame:
    """The n most repeated texts, whole; ties are settled by the hash."""
    by = keys(by)
    top = top_k(counts.filter(F.col("uses") > 1), n, [F.desc("uses"), F.asc("text_key")], by)
    return with_texts(top, df, by).select(*by, "text", "uses")


def self_repetition(df: DataFrame, by=(), cell: str = "1 minute") -> DataFrame:
    """Messages equal to the previous one of the same user, and their percentage.

    Neighbours are compared by the hash of their texts inside (user, cell)
    groups; the first and last message of each cell then meet in a table of
    one row per cell.
    """
    by = keys(by)
    inside = Window.partitionBy(*by, "user_id", "cell").orderBy("ts", "id")
    rows = df.select(*by, "user_id", tx.text_key("text").alias("text"), "ts", "id", time_cell("ts", cell).alias("cell"))
    rows = rows.withColumn("same", F.col("text") == F.lag("text").over(inside)).withColumn(
        "place", F.row_number().over(inside)
    )
    cells = rows.groupBy(*by, "user_id", "cell").agg(
        F.count("*").alias("n"),
        F.count_if("same").alias("repeats"),
        F.min_by("text", "place").alias("first_text"),
        F.max_by(F.when(F.col("place") > 1, F.col("text")), "place").alias("last_text"),
    )
    # A cell of one message carries its text once.
    along = Window.partitionBy(*by, "user_id").orderBy("cell")
    last_text = F.coalesce("last_text", "first_text")
    cells = cells.withColumn("edge", F.col("first_text") == F.lag(last_text).over(along))
    repeats = F.coalesce(F.sum("repeats"), F.lit(0)) + F.count_if("edge")
    return cells.groupBy(*by).agg(
        repeats.alias("self_repetition_count"),
        F.when(F.sum("n") >= 2, F.round(repeats / F.sum("n") * 100.0, 2)).alias("self_repetition_pct"),
    )


def copy_paste_events(df: DataFrame, by=(), window_s: int = C.COPY_PASTE_WINDOW_S, cell: str = "1 minute") -> DataFrame:
    """Per text: its uses, the quick reposts by another user, and everyone taking part.

    Texts are known by their hash; null ones, and null keys, have no copies. A text
    is cut by time before its uses are put in order, and rows of one text never
    meet before that, so one text that makes up a third of all messages is
    spread over the cells of the range. Texts with too few uses, or with one
    user, have no repost or are left out at the end.
    """
    by = keys(by)
    inside = Window.partitionBy(*by, "text", "cell").orderBy("ts", "id")
    rows = df.select(*by, tx.text_key("text").alias("text"), "user_id", "ts", "id", time_cell("ts", cell).alias("cell"))
    rows = rows.dropna(subset=[*by, "text"])
    use = F.struct("ts", "user_id")
    rows = rows.withColumn("prev", F.lag(use).over(inside)).withColumn("place", F.row_number().over(inside))
    handoff = (F.col("user_id") != F.col("prev.user_id")) & (
        seconds_between(F.col("prev.ts"), F.col("ts")) <= window_s
    )
    cells = rows.groupBy(*by, "text", "cell").agg(
        F.count("*").alias("n"),
        F.min_by(use, "place").alias("first"),
        F.max_by(use, "place").alias("last"),
        F.count_if(handoff).alias("events"),
    )
    along = Window.partitionBy(*by, "text").orderBy("cell")
    cells = cells.withColumn("prev", F.lag("last").over(along))
    edge = (F.col("first.user_id") != F.col("prev.user_id")) & (
        seconds_between(F.col("prev.ts"), F.col("first.ts")) <= window_s
    )
    zero, no_user = F.lit(0).cast("bigint"), F.lit(None).cast("string")
    takers = F.explode(F.array("user_id", "prev.user_id"))
    # One row per cell with its counts, and one per user on either side of a repost.
    events = F.col("events") + F.when(edge, F.lit(1)).otherwise(F.lit(0))
    counts = F.array(F.struct(F.col("n"), events.alias("events"), no_user.alias("user_id")))
    ends = F.transform(
        F.array("first.user_id", "prev.user_id"), lambda u: F.struct(zero.alias("n"), zero.alias("events"), u.alias("user_id"))
    )
    border = cells.select(*by, "text", F.inline(F.when(edge, F.concat(counts, ends)).otherwise(counts)))
    people = rows.filter(handoff).select(*by, "text", zero.alias("n"), zero.alias("events"), takers.alias("user_id"))
    return (
        border.unionByName(people)
        .groupBy(*by, F.col("text").alias("text_key"))
        .agg(
            F.sum("n").alias("uses"),
            F.sum("events").alias("occurrences"),
            F.count_distinct("user_id").alias("distinct_users"),
        )
        .filter((F.col("uses") >= C.COPY_PASTE_MIN_OCCURRENCES) & (F.col("occurrences") > 0))
    )


def copy_paste_summary(events: DataFrame, by=()) -> DataFrame:
    """Reposts, and texts with at least one."""
    return events.groupBy(*keys(by)).agg(
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("cross_user_copy_paste_count"),
        F.count("*").alias("cross_user_copy_paste_texts"),
    )


def top_copy_paste_chains(df: DataFrame, events: DataFrame, n: int = C.COPY_PASTE_TOP_N, by=()) -> DataFrame:
    """The n texts with the most reposts, whole; ties are settled by the hash."""
    by = keys(by)
    top = top_k(events, n, [F.desc("occurrences"), F.asc("text_key")], by)
    return with_texts(top, df, by).select(*by, "text", "occurrences", "distinct_users")


def non_ascii(df: DataFrame, by=()) -> DataFrame:
    """Share of non-ASCII characters, and messages that have any."""
    foreign = tx.non_ascii_chars("text")
    return df.groupBy(*keys(by)).agg(
        F.round(
            F.when(F.sum(F.length("text")) > 0, F.sum(foreign) / F.greatest(F.sum(F.length("text")), F.lit(1))), 4
        ).alias("non_ascii_ratio"),
        F.count_if(foreign > 0).alias("messages_with_non_ascii"),
    )


#: Bits of the filter of known names, and runs at the start of a text that it judges before the whole text.
NAME_BITS, HEAD_RUNS = 1 << 20, 32


def _class_tokens(text: Column | str = "text") -> Column:
    bare = tx.clean_text(text, lower=False)
    return F.array_distinct(F.transform(tx.emote_tokens(bare), F.lower))


def _name_filter(known: DataFrame) -> DataFrame:
    """One row: ``NAME_BITS`` bits in longs, of which those of the names (``token``) are set."""
    bit = F.pmod(F.xxhash64("token"), F.lit(NAME_BITS))
    words = known.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("id"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    every = known.sparkSession.range(NAME_BITS // 64, numPartitions=1).join(words, "id", "left")
    listed = F.array_sort(F.collect_list(F.struct("id", F.coalesce("mask", F.lit(0).cast("bigint")).alias("mask"))))
    return every.agg(listed["mask"].alias("__bits"))


def _maybe_known(tokens: Column, bits: Column) -> Column:
    """Whether the filter has every token; false only if one is no known name."""

    def one(token: Column) -> Column:
        bit = F.pmod(F.xxhash64(token), F.lit(NAME_BITS))
        word = F.get(bits, F.shiftright(bit, 6).cast("int"))
        return F.getbit(word, bit.bitwiseAND(F.lit(63)).cast("int")) == 1

    return F.forall(tokens, one)


def emote_only(df: DataFrame, catalog: DataFrame | None = None, by=()) -> DataFrame:
    """Messages made of emotes alone: every token a known name, and at least one emote.

    Known names are the native emotes of the same messages and the catalog;
    both meet the distinct token sets in ordinary joins. Before that, a filter
    of fixed size that holds the names of all keys leaves out texts with a
    token that is surely no name; it judges the first runs of a text first, as
    no token crosses a blank, so few texts are taken apart whole.
    """
    by = keys(by)
    seen = native_counts(df, by).select(*by, F.lower("name").alias("token")).distinct()
    listed, scope = None, []
    if catalog is not None:
        scope = [c for c in by if c in catalog.columns]
        listed = catalog.select(*scope, F.lower("name").alias("token")).distinct()
    native = F.coalesce(F.contains("emotes_tag", F.lit(":")), F.lit(False))
    names = seen.select("token") if listed is None else seen.select("token").unionByName(listed.select("token"))
    head = _class_tokens(F.substring_index("text", " ", HEAD_RUNS))
    maybe = _maybe_known(head, F.col("__bits")) & _maybe_known(_class_tokens(), F.col("__bits"))
    likely = df.withColumn("__bits", _name_filter(names).scalar()).filter(maybe).select(*df.columns)
    rows = likely.select(*by, _class_tokens().alias("tokens"), native.alias("native"))
    groups = df.select(*by).distinct()
    return _emote_only_by_join(rows, seen, listed, scope, by, groups)


def _emote_only_by_join(rows: DataFrame, seen: DataFrame, listed: DataFrame | None, scope, by, groups) -> DataFrame:
    """The same count with joins: distinct token sets, first thinned by their longest token."""

    def mark(table: DataFrame, column: str) -> DataFrame:
        out = table.join(seen.withColumnsRenamed({"token": column}).withColumn("in_seen", F.lit(True)), [*by, column], "left")
        hit = F.coalesce("in_seen", F.lit(False))
        if listed is not None:
            names = listed.withColumnsRenamed({"token": column}).withColumn("in_listed", F.lit(True))
            out = out.join(names, [*scope, column], "left")
            hit = hit | F.coalesce("in_listed", F.lit(False))
        return out.withColumn("known", hit).drop("in_seen", "in_listed")

    # Tokens hold no blanks, so the joined text stands for the set.
    sets = rows.groupBy(*by, "native", F.array_join("tokens", " ").alias("joined")).agg(F.count("*").alias("n"))
    # A condition on the count stays above the aggregate: texts are filtered first, and both readers share one pass.
    sets = sets.withColumn("joined", F.when(F.col("n") > 0, F.col("joined")))
    bare = sets.filter((F.col("joined") == "") & F.col("native")).select(*by, "n")
    longest = F.reduce(
        F.split("joined", " "), F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a)
    )
    likely = mark(sets.filter(F.col("joined") != "").withColumn("longest", longest), "longest").filter("known")
    tokens = likely.select(
        *by, "native", "n", F.sha2("joined", 256).alias("set_id"), F.explode(F.split("joined", " ")).alias("token")
    )
    full = mark(tokens, "token").groupBy(*by, "native", "set_id").agg(F.max("n").alias("n"), F.bool_and("known").alias("ok"))
    counted = full.filter("ok").select(*by, "n").unionByName(bare)
    zero = groups.withColumn("n", F.lit(0)) if by else None
    counted = counted.unionByName(zero) if by else counted
    return counted.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("emote_only"))


def message_classes(df: DataFrame, catalog: DataFrame | None = None, by=()) -> DataFrame:
    """Questions, exclamations, all capitals, emotes only, short and long messages."""
    by = keys(by)
    measured = df.select(
        *by,
        F.right(tx.strip_end("text"), F.lit(1)).alias("__end"),
        "text",
        tx.capitals("text").alias("__capitals"),
        F.length("text").alias("__length"),
    )
    # Where the start of a text alone has too many letters for its capitals, the rest of it is not counted.
    share, capitals = F.lit(C.CAPS_SHARE), F.col("__capitals")
    letters = tx.letters("text")
    start = tx.letters(F.left("text", (capitals * 4 + 64).cast("int")))
    caps = ~(start * share > capitals) & (letters >= C.MIN_ALPHA_FOR_CAPS) & (capitals >= letters * share)
    shapes = measured.groupBy(*by).agg(
        F.count_if(F.col("__end") == "?").alias("questions"),
        F.count_if(F.col("__end") == "!").alias("exclamations"),
        F.count_if(caps).alias("all_caps"),
        F.count_if(F.col("__length") <= C.SHORT_MESSAGE_LEN).alias("short_messages"),
        F.count_if(F.col("__length") >= C.LONG_MESSAGE_LEN).alias("long_messages"),
    )
    return attach(shapes, emote_only(df, catalog, by), by, ["emote_only"])


def checks(
    df: DataFrame,
    by=(),
    arrival: str | None = None,
    block: int = 1_000_000,
    days: DataFrame | None = None,
    hours: DataFrame | None = None,
) -> DataFrame:
    """Data-quality checks, one row each: name, whether it failed, and the figures behind it.

    ``days`` and ``hours`` are the finished tables of ``per_day`` and
    ``hourly``: a day of the range that is not in the one, or hours that do
    not add up to all messages in the other, are reported. Without them they
    are made from the messages.
    Order of arrival is only known when a column for it is given; time going
    back by a second or more against it is then reported.
    """
    by = keys(by)
    figures = [
        F.count("*").alias("total"),
        F.avg(F.length("text")).alias("avg_length"),
        F.count_if(F.length("text") == 0).alias("empty_texts"),
        (F.datediff(F.max(F.to_date("ts")), F.min(F.to_date("ts"))) + 1).alias("days_spanned"),
    ]
    base = df.groupBy(*by).agg(*figures)
    rollup = activity(df, by)
    days = temporal.per_day(rollup, by) if days is None else days
    hours = temporal.hourly(rollup, by) if hours is None else hours
    base = attach(base, days.groupBy(*by).agg(F.count("*").alias("days_listed")), by, ["days_listed"])
    base = attach(base, hours.groupBy(*by).agg(F.sum("messages").alias("with_hour")), by, ["with_hour"])
    base = base.fillna(0, ["days_listed", "with_hour"])
    back = F.lit(None).cast("bigint")
    if arrival is not None:
        base = attach(base, _backsteps(df, by, arrival, block), by, ["backsteps"])
        back = F.coalesce("backsteps", F.lit(0))
    mean = F.coalesce(F.round("avg_length", 2), F.lit(0.0)).cast("string")
    number = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    rows = [
        ("avg_length_small", F.col("avg_length") < C.MIN_PLAUSIBLE_AVG_MESSAGE_LEN, mean),
        ("avg_length_large", F.col("avg_length") > C.MAX_PLAUSIBLE_AVG_MESSAGE_LEN, mean),
        ("days_missing", F.col("days_listed") < F.col("days_spanned"), number("days_listed")),
        ("hours_do_not_add_up", F.col("with_hour") != F.col("total"), number("with_hour")),
        ("empty_texts", F.col("empty_texts") > 0, number("empty_texts")),
    ]
    if arrival is not None:
        rows.append(("time_goes_back", back > 0, back.cast("string")))
    table = F.array(
        *[
            F.struct(F.lit(n).alias("check"), F.coalesce(f, F.lit(False)).alias("failed"), d.alias("detail"))
            for n, f, d in rows
        ]
    )
    return base.select(*by, F.inline(table))


def _backsteps(df: DataFrame, by, arrival: str, block: int) -> DataFrame:
    """Neighbours in arrival order whose time goes back by a second or more.

    Arrival numbers are cut into blocks of ``block`` numbers; only the edges
    of blocks meet in one ordered table.
    """
    inside = Window.partitionBy(*by, "block").orderBy(arrival)
    rows = df.select(*by, arrival, "ts", F.floor(F.col(arrival) / block).alias("block"))
    rows = rows.withColumn("back", seconds_between(F.lag("ts").over(inside), F.col("ts")) < 0)
    blocks = rows.groupBy(*by, "block").agg(
        F.count_if("back").alias("back"),
        F.min_by("ts", arrival).alias("first_ts"),
        F.max_by("ts", arrival).alias("last_ts"),
    )
    along = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("block")
    edge = seconds_between(F.lag("last_ts").over(along), F.col("first_ts")) < 0
    blocks = blocks.withColumn("edge", edge)
    return blocks.groupBy(*by).agg((F.sum("back") + F.count_if("edge")).alias("backsteps"))
