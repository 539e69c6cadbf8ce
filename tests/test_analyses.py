"""Known answers on small inputs."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from conftest import START, one, rows

from parley.functions import text as tx
from parley.functions.stats import erfc, log_gamma, poisson_tail
from parley.operators import anomalies, bots, cohorts, concentration, emotes, health, language, links, mentions
from parley.operators import overview, roles, sessions, temporal, words


def day(n, hour=12):
    return datetime(2024, 1, 1, hour) + timedelta(days=n)


def test_overview_counts_lengths_and_words(chat):
    got = overview.overview(chat(("a", "hi", 0), ("b", "hello world foo bar", 60))).first()
    assert (got.total_messages, got.unique_chatters, got.days_spanned) == (2, 2, 1)
    assert (got.median_message_length, got.max_message_length, got.avg_words_per_message) == (10.5, 19, 2.5)


def test_overview_of_nothing(chat):
    got = overview.overview(chat()).first()
    assert (got.total_messages, got.unique_chatters, got.days_spanned, got.avg_message_length) == (0, 0, 0, 0.0)
    assert got.median_message_length is None


def test_top_chatters_hours_and_days(chat):
    per_user = {"a": 10, "b": 8, "c": 7, "d": 6, "e": 5, "f": 3, "g": 1}
    users = [u for u, n in per_user.items() for _ in range(n)]
    at = lambda i: datetime(2024, 1, 15 + (i >= 25), 10 if i < 15 else 11 if i < 25 else 12, i % 60)
    m = chat(*[(u, "x", at(i)) for i, u in enumerate(users)])
    top = [r.user_id for r in overview.top_chatters(m, 5).orderBy("message_count", ascending=False).collect()]
    assert top == list("abcde")
    hours = {r.hour: r.messages for r in temporal.hourly(m).collect()}
    assert len(hours) == 24 and (hours[10], hours[11], hours[12], sum(hours.values())) == (15, 10, 15, 40)
    assert [r[1] for r in rows(temporal.per_day(m))] == [25, 15]


def test_top_chatters_keep_the_last_name_and_all_channels(chat):
    m = chat(
        ("Old", "x", 0, {"user_id": "1", "channel": "b"}),
        ("New", "xyz", 90000, {"user_id": "1", "channel": "a"}),
        ("Other", "xyz", 5, {"user_id": "2"}),
    )
    first = overview.top_chatters(m, 1).first()
    assert (first.username, first.active_days, first.channels) == ("New", 2, ["a", "b"])
    assert first.engagement_score == pytest.approx(0.5 + 0.3 + 0.2 * 2 / 3, abs=1e-4)


def test_heat_map_starts_on_monday(chat):
    heat = temporal.weekday_hour(chat(("a", "x", datetime(2024, 1, 15, 10, 30)), ("a", "x", datetime(2024, 1, 21, 23))))
    cells = {(r.weekday, r.hour): r.messages for r in heat.collect()}
    assert len(cells) == 168 and cells[0, 10] == 1 and cells[6, 23] == 1 and sum(cells.values()) == 2


def test_peaks_and_concurrency(chat):
    m = chat(("a", "x", 0), ("b", "x", 60), ("c", "x", 110), ("a", "x", 400))
    bins = temporal.bins_5m(m)
    assert one(temporal.peak_concurrency(bins)) == (3, START)
    assert rows(temporal.peaks_5m(bins))[0] == (START, 3)


def test_quiet_days_are_filled_in_order(chat):
    m = chat(("a", "x", day(0)), ("a", "x", day(3)), ("b", "x", day(3)))
    assert [r[1] for r in rows(temporal.per_day(m))] == [1, 0, 0, 2]
    assert [r[1:] for r in rows(temporal.new_returning(m))] == [(1, 0), (0, 0), (0, 0), (1, 1)]


def test_seasonality_shows_the_busy_weekday(chat):
    m = chat(*[("a", "x", day(d) + timedelta(seconds=k)) for d in range(14) for k in range(30 if d % 7 == 5 else 10)])
    season = {r.weekday: r.weekday_index for r in temporal.weekly_seasonality(temporal.per_day(m)).collect()}
    assert sum(season.values()) / 7 == pytest.approx(1, abs=1e-3) and season[5] == max(season.values()) > 1
    short = temporal.per_day(chat(("a", "x", day(0)), ("a", "x", day(5))))
    assert temporal.trend(short).count() == 0 and temporal.weekly_seasonality(short).count() == 0


def test_sessions_and_quantiles(chat):
    m = chat(("a", "x", 0), ("a", "x", 300), ("a", "x", 3600), ("b", "x", 0))
    got = sessions.sessions(m, 15).first()
    assert (got.total_sessions, got.longest_session_minutes, got.median_session_minutes, got.p90_session_minutes) == (3, 5.0, 0.0, 5.0)
    assert overview.chatter_quantiles(m).first().p99 == 3.0


def test_a_pause_of_exactly_the_gap_splits(chat):
    m = chat(("a", "x", 0), ("a", "x", 899), ("a", "x", 899 + 900))
    assert sorted(r.messages for r in sessions.session_table(m, 15).collect()) == [1, 2]


def test_one_message_has_no_median_session(chat):
    got = sessions.sessions(chat(("a", "x", 0))).first()
    assert (got.total_sessions, got.avg_messages_per_session, got.median_session_minutes) == (1, 1.0, None)
    assert sessions.sessions(chat()).first().total_sessions == 0


def test_lorenz_and_gini(chat):
    m = chat(*[("a", "x", i) for i in range(10)], *[(u, "x", 0) for u in "bcde"[:4]])
    share = dict(rows(concentration.lorenz(m)))
    assert share == {1.0: 71.43, 5.0: 71.43, 10.0: 71.43, 25.0: 78.57, 50.0: 85.71}
    got = concentration.concentration(m).first()
    counts = [1, 1, 1, 1, 10]
    gini = abs(sum((2 * i - 6) * x for i, x in enumerate(counts, 1))) / (5 * 14)
    assert (got.gini_coefficient, got.top_10pct_share) == (round(gini, 4), 71.43)


def test_bots_by_regular_gaps_and_same_text(chat):
    m = chat(*[("bot", "same", 10 * i) for i in range(50)], *[("man", f"t{i}", i * i) for i in range(50)])
    found = bots.bot_scores(m).collect()
    assert [(r.user_id, r.score, r.signals) for r in found] == [("bot", 0.8, ["regular_interval", "low_diversity"])]


def test_length_trend(chat):
    m = chat(*[("a", "x" * n, day(d)) for d, n in ((0, 10), (4, 20), (9, 30))])
    assert one(anomalies.length_trend(m)) == 10.0
    assert one(anomalies.length_trend(chat(("a", "x", 0)))) is None


def test_cohorts(chat):
    m = chat(("a", "x", day(0)), ("b", "x", day(1)), ("a", "x", day(14)))
    assert [r[1:] for r in rows(cohorts.cohort_retention(m))] == [(2, 0, 100.0), (2, 2, 50.0)]
    many = chat(*[(f"u{w}", "x", day(7 * w)) for w in range(10)])
    assert cohorts.cohort_retention(many).select("cohort_week").distinct().count() == 10
    weeks = {r.cohort_week for r in cohorts.cohort_retention(many, latest=8, offsets=8).collect()}
    assert len(weeks) == 8 and min(weeks) == day(14).date()


def test_anomalies_need_enough_bins(chat):
    quiet = [("a", "x", 300 * i) for i in range(40)]
    burst = [("b", "x", 300 * 20 + i) for i in range(50)]
    bins = temporal.bins_5m(chat(*quiet, *burst))
    found = anomalies.anomalies(bins, 3.0).collect()
    assert [(r.window_start, r.message_count) for r in found] == [(START + timedelta(seconds=6000), 51)]
    assert found[0].p_value == 0.0 and found[0].z_score > 3
    assert anomalies.anomalies(temporal.bins_5m(chat(*quiet[:5])), 1.0).count() == 0


def plain_tail(k, lam, upper):
    if (k <= 0) if upper else (k < 0):
        return float(upper)
    if lam <= 0:
        return float(not upper)
    if lam >= 30:
        return 0.5 * math.erfc((k - 0.5 - lam) / math.sqrt(2 * lam)) if upper else 0.5 * math.erfc((lam - k - 0.5) / math.sqrt(2 * lam))
    terms = (math.exp(j * math.log(lam) - lam - math.lgamma(j + 1)) for j in (range(k, k + 400) if upper else range(k + 1)))
    return min(1.0, math.fsum(terms))


def test_poisson_tails(spark):
    cases = [(k, lam, up) for k in (-1, 0, 1, 2, 5, 10, 20, 29, 30, 60, 200) for lam in (0.0, 1e-9, 0.3, 1.0, 5.0, 10.0, 29.99, 30.0, 50.0, 4e5) for up in (True, False)]
    rows = spark.createDataFrame(cases, "k long, lam double, up boolean")
    got = {(r.k, r.lam, r.up): r.p for r in rows.withColumn("p", poisson_tail("k", "lam", F.col("up"))).collect()}
    for case in cases:
        assert got[case] == pytest.approx(plain_tail(*case), abs=1e-9, rel=1e-9), case
    assert got[20, 10.0, True] == pytest.approx(0.0035, abs=1e-4)
    assert got[10, 10.0, False] + plain_tail(11, 10.0, True) == pytest.approx(1)


def test_gamma_and_error_functions(spark):
    xs = [1e-6, 0.1, 0.5, 1.0, 1.5, 3.0, 10.0, 1e3, 1e8]
    zs = [-6.0, -1.5, -1e-9, 0.0, 1e-3, 0.7, 1.3, 3.0, 8.0, 20.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(log_gamma(F.col("x"))).collect()]
    assert got == [pytest.approx(math.lgamma(x), abs=1e-9, rel=1e-12) for x in xs]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(erfc(F.col("z"))).collect()]
    assert got == [pytest.approx(math.erfc(z), abs=1e-9) for z in zs]


def test_native_emotes_by_position(chat):
    m = chat(
        ("a", "Kappa hello Kappa", 0, {"emotes": "25:0-4,12-16"}),
        ("a", "Kappa Keepo", 1, {"emotes": "25:0-4/1902:6-10"}),
        ("a", "short", 2, {"emotes": "99:40-44/98:x-y/97"}),
        ("a", "none", 3),
    )
    assert rows(emotes.native_counts(m)) == [("Kappa", 3), ("Keepo", 1), ("[98]", 1), ("[99]", 1)]


def test_catalog_names_are_tokens_and_never_counted_twice(chat, spark):
    m = chat(("a", "Kappa KEKW kekw KEKW_2 KEKW", 0, {"emotes": "25:0-4"}), ("b", "Kappa", 1))
    names = spark.createDataFrame([("b1", "KEKW"), ("25", "Kappa")], "emote_id string, name string")
    assert rows(emotes.top_emotes(m, names)) == [("KEKW", 2), ("Kappa", 1)]


def test_pairs_centrality_entropy(chat):
    tag = "25:0-4/1902:6-10"
    m = chat(*[("a", "Kappa Keepo", i, {"emotes": tag}) for i in range(2)], ("a", "Kappa Kappa", 9, {"emotes": "25:0-4,6-10"}))
    pairs = emotes.pair_counts(m)
    assert rows(pairs) == [("Kappa", "Keepo", 2)]
    assert rows(emotes.emote_centrality(pairs)) == [("Kappa", 1), ("Keepo", 1)]
    four = chat(("a", "aa bb cc dd", 0, {"emotes": "1:0-1/2:3-4/3:6-7/4:9-10"}))
    assert one(emotes.emote_entropy(emotes.native_counts(four))) == 2.0
    assert one(emotes.emote_entropy(emotes.native_counts(chat(("a", "aa", 0, {"emotes": "1:0-1"}))))) == 0.0
    assert one(emotes.emote_entropy(emotes.native_counts(chat(("a", "aa", 0))))) is None


def test_pairs_leave_out_messages_with_over_twenty_kinds(chat):
    def wide(n):
        text = " ".join(f"e{i:02d}" for i in range(n))
        return ("a", text, n, {"emotes": "/".join(f"{i}:{4 * i}-{4 * i + 2}" for i in range(n))})

    assert emotes.pair_counts(chat(wide(20)), most=20).count() == 190
    assert emotes.pair_counts(chat(wide(21)), most=20).count() == 0
    assert one(emotes.messages_above(chat(wide(20), wide(21)), 20)) == 1
    assert emotes.pair_counts(chat(wide(21))).count() == 210


def test_emote_diversity(chat):
    six = [("a", "Kappa", i, {"emotes": "25:0-4"}) for i in range(4)] + [("a", "Keepo", 9 + i, {"emotes": "2:0-4"}) for i in range(2)]
    m = chat(*six, ("b", "Kappa", 50, {"emotes": "25:0-4"}))
    assert rows(emotes.emote_diversity(m)) == [("a", "a", 6, 2, 0.3333)]


def test_words_vocabulary_and_seen_emotes(chat):
    m = chat(("a", "Hello hello world http://x.de/hello @hello don't ''' x", 0), ("a", "Kappa the żółć", 1, {"emotes": "25:0-4"}))
    counts = words.word_counts(m, emotes.emote_counts(m))
    assert rows(counts) == [("don't", 1), ("hello", 2), ("world", 1), ("żółć", 1)]
    assert one(words.vocabulary(counts)) == (4, 0.8, 0.75)
    assert one(words.vocabulary(words.word_counts(chat(("a", "the", 0))))) == (0, None, None)


def test_zipf(chat):
    text = " ".join(f"word{r:02d} " * round(600 / r) for r in range(1, 31))
    assert one(words.zipf_slope(words.word_counts(chat(("a", text, 0))))) == pytest.approx(-1, abs=0.2)
    assert one(words.zipf_slope(words.word_counts(chat(("a", "only three words", 0))))) is None


def test_commands_start_at_once(chat):
    m = chat(("a", "!So hi", 0), ("b", "!so", 1), ("a", "! so", 2), ("a", "!!so", 3), ("a", "!", 4), ("a", " !so", 5))
    assert rows(words.command_counts(m)) == [("so", 2, 2)]
    assert one(words.messages_with_commands(m)) == 2


def test_phrases_need_two_uses(chat):
    m = chat(("a", "good morning all", 0), ("b", "Good morning", 1), ("c", "morning", 2), ("c", "", 3))
    assert rows(words.top_phrases(m)) == [("good morning", 2)]


def test_urls_are_folded_and_counted_per_paste(chat):
    m = chat(
        ("a", "https://EXAMPLE.com/x/ https://example.com/x", 0),
        ("b", "look: https://youtube.com/watch?v=AbC! (https://youtu.be/q?)", 1),
        ("c", "HTTPS://no.link", 2),
    )
    counts = links.url_counts(m)
    assert rows(counts) == [("https://example.com/x", 2), ("https://youtu.be/q", 1), ("https://youtube.com/watch?v=AbC", 1)]
    assert rows(links.top_domains(counts)) == [("example.com", 2), ("youtu.be", 1), ("youtube.com", 1)]
    assert one(links.messages_with_links(m)) == 2 and one(links.unique_urls(counts)) == 3
    assert links.platform_links(counts).first().asDict() == {
        "twitch_clips": 0, "youtube": 2, "discord": 0, "x_twitter": 0, "kick": 0, "other": 2,
    }


def test_platform_rules_are_substrings_unless_strict(chat):
    counts = links.url_counts(chat(("a", "https://netflix.com/x https://x.com/a https://www.twitch.tv/a/clip/b", 0)))
    assert links.platform_links(counts).first().x_twitter == 2
    strict = links.platform_links(counts, strict=True).first()
    assert (strict.x_twitter, strict.twitch_clips, strict.other) == (1, 1, 1)


def test_mention_graph_and_mutual_pairs(chat):
    m = chat(("A", "@b hi @B", 0), ("b", "@a", 1), ("c", "@A @c mail@a.de é@bob", 2), ("c", "@c", 3))
    edges = mentions.edge_counts(m)
    assert rows(edges) == [("a", "b", 2), ("b", "a", 1), ("c", "a", 1)]
    assert one(mentions.messages_with_mentions(m)) == 4
    assert rows(mentions.mention_graph(edges)) == [("a", 2, 2, 4), ("b", 2, 1, 3), ("c", 0, 1, 1)]
    assert rows(mentions.mutual_mentions(edges)) == [("a", "b", 2, 1, 3)]
    assert rows(mentions.top_mentions(edges, 1)) == [("a", 2)]


@pytest.mark.parametrize("pause,count", [(0, 1), (299, 1), (300.9, 1), (301, 0), (5000, 0)])
def test_replies_within_five_minutes(chat, pause, count):
    m = chat(("bob", "hi", 37), ("alice", "@Bob yes", 37 + pause))
    assert one(mentions.quote_reply_count(mentions.reply_counts(m))) == count


def test_duplicates(chat):
    m = chat(*[("a", "x" * 301, i) for i in range(3)], ("a", "y", 9), ("b", "y", 10), ("b", "z", 11))
    counts = health.text_counts(m)
    assert one(health.duplicate_count(counts)) == 3
    assert rows(health.top_repeated(m, counts)) == [("x" * 301, 3), ("y", 2)]


def test_self_repetition(chat):
    assert one(health.self_repetition(chat(*[("u", t, i * 100) for i, t in enumerate("aabb")]))) == (2, 50.0)
    assert one(health.self_repetition(chat(("u", "a", 0), ("u", "a", 1), ("v", "a", 2), ("w", "b", 3)))) == (1, 25.0)
    assert one(health.self_repetition(chat(("u", "a", 0)))) == (0, None)


@pytest.mark.parametrize("pause,events", [(20, 2), (60.9, 2), (61, 0)])
def test_copy_paste(chat, pause, events):
    m = chat(*[(u, "copy", 30 + pause * i) for i, u in enumerate("abc")], ("a", "own", 0), ("b", "own", 1))
    found = health.copy_paste_events(m)
    assert rows(health.copy_paste_summary(found)) == [(events, 1 if events else 0)]
    assert rows(health.top_copy_paste_chains(m, found)) == ([("copy", 2, 3)] if events else [])


def test_non_ascii(chat):
    assert one(health.non_ascii(chat(("a", "hello", 0), ("a", "zażółć", 1)))) == (round(4 / 11, 4), 1)
    assert one(health.non_ascii(chat())) == (None, 0)


@pytest.mark.parametrize("by", [(), ("channel",)])
def test_message_classes(chat, spark, by):
    m = chat(
        ("a", "really?  ", 0),
        ("a", "wow!", 1),
        ("a", "ok", 2),
        ("a", "x" * 200, 3),
        ("a", "LOUD NOISES", 4),
        ("a", "Kappa", 5, {"emotes": "25:0-4"}),
        ("a", "kekw KAPPA żółć", 6),
        ("a", "...", 7),
        ("a", "Kappa hello", 8, {"emotes": "25:0-4"}),
    )
    names = spark.createDataFrame([("b1", "KEKW")], "emote_id string, name string")
    got = health.message_classes(m, names, by).first().asDict()
    got.pop("channel", None)
    assert got == {
        "questions": 1, "exclamations": 1, "all_caps": 1, "short_messages": 2, "long_messages": 1, "emote_only": 2,
    }


def test_roles_and_rosters(chat):
    m = chat(
        ("a", "x", 0, {"role": "vip"}),
        ("a", "x", 1, {"role": "moderator"}),
        ("a", "x", 2),
        ("b", "x", 3, {"role": "subscriber"}),
        ("c", "x", 4),
    )
    assert rows(roles.staff_list(m), "user_id", "role", "message_count") == [("a", "moderator", 3)]
    assert rows(roles.subscriber_list(m), "user_id", "role") == [("b", "subscriber")]
    assert one(roles.subscriber_count(m)) == 1
    assert ("regular", 2, 2) in rows(roles.roles(m))


def test_checks(chat):
    failed = lambda df, **kw: {r.check for r in health.checks(df, **kw).collect() if r.failed}
    assert failed(chat(("a", "plain text", 0))) == set()
    assert failed(chat(("a", "", 0), ("a", "x", 1))) == {"avg_length_small", "empty_texts"}
    assert failed(chat(("a", "x" * 500, 0))) == {"avg_length_large"}
    from pyspark.sql import functions as F

    late = chat(("a", "plain text", 100), ("a", "plain text", 99.5), ("a", "plain text", 50))
    late = late.withColumn("arrival", F.substr("id", F.lit(2)).cast("bigint"))
    assert failed(late, arrival="arrival") == {"time_goes_back"}
    assert {r.detail for r in health.checks(late, arrival="arrival").collect() if r.failed} == {"1"}


def test_language_shares(chat):
    m = chat(("a", "some english text", 0), ("b", "trochę żółtego tekstu", 1), ("c", "more english words", 2), ("d", "zzzzzzzzzzzz", 3), ("e", "hi", 4))
    label = F.when(F.contains("text", F.lit("zzz")), None).when(F.contains("text", F.lit("ż")), "pl").otherwise("en")
    assert rows(language.language_breakdown(m, label)) == [("en", 66.67), ("pl", 33.33)]
    assert rows(language.language_by_day(m, label), "language", "percentage") == [("en", 66.67)]


def test_first_message_hours_and_active_chatters(chat):
    m = chat(("a", "x", day(0, 9)), ("a", "x", day(0, 8)), ("b", "x", day(1, 8)), ("a", "x", day(1, 7)))
    hours = dict(rows(temporal.first_message_hours(m)))
    assert hours[8] == 2 and sum(hours.values()) == 2
    assert one(overview.active_chatters(m)) == (1.5, 2)


def test_token_counts_read_runs_between_blanks(chat, monkeypatch):
    """Every kind as the patterns find it in whole texts, however often tasks hand on, in one pass over the messages."""
    texts = ["Kappa  it's @Bob see http://a.b/c,d Straße ÄÖ x\ty", "a@b @c_d! http", None, "", " ", "ΑΣ Σ ΟΔΟΣ 世界 hello_world", "x" * 300]
    df = chat(*[(f"u{i % 2}", t, i, {"emotes_tag": "25:0-4/9:90-95" if i % 3 == 0 else None}) for i, t in enumerate(texts * 3)])
    kinds = {"native": tx.parse_emotes("emotes_tag", "text"), "token": tx.emote_tokens("text"), "word": tx.words("text")}
    want = {}
    for kind, names in kinds.items():
        rows = df.filter(F.length("emotes_tag") > 0) if kind == "native" else df
        for r in rows.select("user_id", F.explode(names).alias("name")).collect():
            want[r.user_id, kind, r["name"]] = want.get((r.user_id, kind, r["name"]), 0) + 1
    for most in (200_000, 1):
        monkeypatch.setattr(emotes, "RUNS", most)
        counted = emotes.token_counts(df, "user_id")
        assert {(r.user_id, r.kind, r["name"]): r.uses for r in counted.collect()} == want
    slope = words.zipf_slope(words.words_apart(emotes.token_counts(df), df.select(F.lit("Kappa").alias("name"))))
    slope.collect()
    plan = slope._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 1


def test_message_classes_with_long_texts(chat):
    """Texts whose first runs are names but not all, capitals late in a text, and names of another channel."""
    names = " ".join(["Kappa"] * 40)
    shout = "ABCDEFGHIJ " * 60
    df = chat(
        ("a", names, 0), ("a", f"{names} word", 1), ("b", f"{names} Keepo", 2), ("b", "@x http://y.z", 3, {"emotes_tag": "25:0-1"}),
        ("a", shout, 4), ("a", "a" * 300 + shout * 3, 5), ("b", "quiet " * 200 + shout, 6), ("b", "why?  ", 7), ("a", None, 8),
    )
    catalog = df.select(F.lit("Kappa").alias("name")).distinct()
    row = health.message_classes(df, catalog).first()
    assert (row.emote_only, row.all_caps, row.questions, row.exclamations) == (1, 2, 1, 0)


@pytest.mark.parametrize("by", [(), ("channel",), ("channel", "role")])
@pytest.mark.parametrize("at_once", [2, 7, 1 << 20])
def test_pairs_of_words_are_counted_before_they_are_texts(chat, monkeypatch, by, at_once):
    monkeypatch.setattr(words, "PAIR_WORDS", at_once)
    texts = ["aa bb cc", "AA  bb", None, "", "aa", "bb cc aa bb cc aa bb cc", "é1 ünï http://x.y/aa bb @who cc", "x aa, bb; cc's dd", "aa bb"]
    m = chat(*[("u", t, k, {"channel": (None, "c", "d")[k % 3], "role": f"r{k % 2}"}) for k, t in enumerate(texts * 3)])
    pairs = m.select(*by, tx.words("text").alias("w")).select(*by, F.explode(tx.bigrams(F.col("w"))).alias("phrase"))
    want = pairs.groupBy(*by, "phrase").agg(F.count("*").alias("uses"))
    got = words.phrase_counts(m, by)
    assert rows(got) == rows(want) and got.columns == want.columns and got.count() > 5
    assert "Generate" not in words.top_phrases(m, 20, by)._jdf.queryExecution().executedPlan().toString()
