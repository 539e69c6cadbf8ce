"""Parameters, bundle, channels, comparison, registry, and the shape of physical plans."""

import re
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from parley.operators import overview, temporal
from parley.plans import bundle, channels, compare, export
from parley.plans.params import Params, default_sections, preset_sections, schema
from parley.plans.registry import CURRENT, REGISTRY, Inputs, listing
from parley.plans.run import history, load, report
from parley.session import checkpointed
from parley.sources import store

SMALL = "/root/testdata/sf0.001"
A, B = datetime(2024, 3, 1), datetime(2024, 3, 11)


def test_params_check_their_bounds():
    ok = Params(A, B, channels=(" Chan ", "chan", "Other"))
    assert ok.channels == ("Chan", "Other") and ok.channel is None and Params(A, B, channel="x").channel == "x"
    for bad in (
        {"channels": ()},
        {"channels": ("a", "b", "c", "d")},
        {"channel": "x", "top_n": 4},
        {"channel": "x", "session_gap_minutes": 121},
        {"channel": "x", "anomaly_sigma": 0.5},
        {"channel": "x", "user": "  "},
        {"channel": "x", "max_range_days": 5},
        {"channel": "x", "sections": {"nonsense"}},
        {"channel": "x", "comparison_mode": "custom"},
        {"channel": "x", "comparison_mode": "never"},
    ):
        with pytest.raises(ValueError):
            Params(A, B, **bad)
    with pytest.raises(ValueError):
        Params(B, A, channel="x")


def test_listing_of_parameters_is_what_is_validated():
    listed = {f["name"]: f for f in schema()}
    assert listed["from_date"]["required"] and not listed["top_n"]["required"] and listed["channels"]["default"] == ()
    assert listed["sections"]["default"] == sorted(default_sections()) and set(listed["sections"]["default"]) < set(listed["sections"]["choices"])
    bounded = [f for f in listed.values() if f["minimum"] is not None]
    assert len(bounded) == 7
    for f in bounded:
        span = {} if f["name"] != "max_range_days" else {"to_date": A + timedelta(hours=1)}
        for value in (f["minimum"], f["maximum"], f["default"]):
            assert getattr(Params(**{"from_date": A, "to_date": B, "channel": "x", f["name"]: value, **span}), f["name"]) == value
        for value in (f["minimum"] - 1, f["maximum"] + 1, f["minimum"] - 0.01, f["maximum"] + 0.01):
            with pytest.raises(ValueError, match=f"{f['name']} must be between"):
                Params(**{"from_date": A, "to_date": B, "channel": "x", f["name"]: value, **span})
    for name in ("channel_id_type", "user_id_type", "comparison_mode"):
        assert listed[name]["default"] in listed[name]["choices"]
        with pytest.raises(ValueError, match=f"unknown {name}"):
            Params(A, B, channel="x", **{name: "else"})


@pytest.mark.parametrize(
    "mode,start",
    [
        ("previous_period", A - timedelta(days=10)),
        ("previous_week", A - timedelta(days=7)),
        ("previous_month", A - timedelta(days=30)),
        ("previous_year", datetime(2023, 3, 1)),
    ],
)
def test_comparison_windows(mode, start):
    assert Params(A, B, channel="x", comparison_mode=mode).comparison_window() == (start, A)


def test_leap_day_and_custom_windows():
    leap = Params(datetime(2024, 2, 29), B, channel="x", comparison_mode="previous_year")
    assert leap.comparison_window()[0] == datetime(2023, 2, 28)
    custom = Params(A, B, channel="x", comparison_mode="custom", compare_from_date=datetime(2020, 1, 1), compare_to_date=datetime(2020, 1, 2))
    assert custom.comparison_window() == (datetime(2020, 1, 1), datetime(2020, 1, 2))


def test_listing_names_every_query():
    assert {entry["name"] for entry in listing()} == set(REGISTRY)


def test_presets_nest():
    quick, standard, everything = (preset_sections(p) for p in ("quick", "standard", "everything"))
    assert quick < standard < everything and "phrases" in everything and "anomalies" not in quick


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    stored = str(tmp_path_factory.mktemp("stored") / "messages")
    Inputs(spark, SMALL).with_lang.write.parquet(stored)
    return Inputs(spark, SMALL, stored)


def test_totals_agree_with_each_other(inputs):
    m = inputs.messages
    total = m.count()
    assert sum(r.messages for r in temporal.hourly(m).collect()) == total
    assert sum(r.messages for r in temporal.per_day(m).collect()) == total
    assert sum(r.messages for r in temporal.weekday_hour(m).collect()) == total
    new = sum(r.new_chatters for r in temporal.new_returning(m).collect())
    assert new == overview.overview(m).first().unique_chatters
    assert sum(r.total_messages for r in channels.channel_totals(m, ["ch0", "ch1", "ch2"]).collect()) == total


CHECKED = """overview top_chatters weekday_hour trend top_emotes vocabulary platform_links mention_graph copy_paste_summary
message_classes self_repetition anomalies cohort_retention bot_scores quote_reply_count emote_entropy sessions lorenz""".split()


def test_per_channel_sections_match_a_run_per_channel(inputs):
    p = Params(A, B, channels=("ch0", "ch1"), sections=preset_sections("everything"))
    one_channel = inputs.messages.filter("channel = 'ch1'")
    names = inputs.catalog.filter("channel = 'ch1'")
    alone = bundle.chat_stats(one_channel, p, names, all_urls=False)
    split = channels.per_channel(inputs.messages, p, inputs.catalog)
    assert set(alone) == set(split) and len(alone) > 45
    for name in CHECKED:
        table = alone[name]
        drop = ["channels"] if "channels" in table.columns else []
        mine = split[name].filter("channel = 'ch1'").select(*table.drop(*drop).columns)
        as_text = lambda df: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())
        assert as_text(table.drop(*drop)) == as_text(mine), name


def test_a_whole_run(inputs, spark, tmp_path):
    root = str(tmp_path / "store")
    store.merge_store(spark, root, inputs.messages)
    p = Params(
        datetime(2024, 1, 16), datetime(2024, 1, 31), channels=("ch0", "CH1"), user="user3",
        compare_previous=True, sections=preset_sections("quick"),
    )
    p_named = replace(p, channels=("ch0", "ch1"))
    everything = load(spark, root, p_named)
    assert set(r[0] for r in rows(everything.select("channel").distinct())) == {"ch0", "ch1"}
    parts = report(everything, p_named, inputs.catalog)
    assert set(parts) == {"pooled", "summaries", "per_channel", "comparison"}
    mine = inputs.messages.filter("user_id = '3' and ts >= '2024-01-16'").count()
    assert parts["pooled"]["overview"].first().total_messages == mine
    totals = {r.channel: r.total_messages for r in parts["summaries"]["totals"].collect()}
    assert totals["ch0"] > mine and not any(r.failed for r in parts["summaries"]["checks"].collect())
    assert {r.period for r in parts["comparison"]["overview"].collect()} == {"current", "previous"}
    only = report(everything, replace(p_named, user_everywhere=True), inputs.catalog)
    assert {r.channel: r.total_messages for r in only["summaries"]["totals"].collect()} == {"ch0": mine, "ch1": 0}


def test_pooled_and_per_channel_sections_come_from_one_count(inputs):
    m = inputs.messages.withColumn("channel", F.when(F.col("channel") == "ch1", F.lit(" CH1")).otherwise(F.col("channel")))
    p = Params(*CURRENT, channels=("ch0", "ch1", "ch2"), sections=preset_sections("everything"))
    fine = bundle.Shared(m, None, channels.BY, "folder")
    kept = ("token_counts", "pair_counts", "url_counts", "edge_counts", "text_counts", "bins", "rollup")
    for by, own in (((), m), (channels.BY, channels.plain_names(m))):
        shared, alone = bundle.Shared(own, inputs.names, by, None, fine), bundle.Shared(own, inputs.names, by)
        for name in kept:
            got = getattr(shared, name)
            assert not re.search("regexp_extract_all|emotes_tag", got._jdf.queryExecution().executedPlan().toString()), name
            if name != "rollup":
                want = getattr(alone, name)
                assert rows(got, *want.columns) == rows(want), name
        a, b = (bundle.chat_stats(own, p, inputs.names, by, shared=s) for s in (shared, alone))
        for name in ("overview", "top_chatters", "top_words", "top_emotes", "emote_pairs", "peaks_5m", "roles", "top_urls", "mention_graph", "staff_list"):
            assert rows(a[name]) == rows(b[name]), name


def test_a_range_outside_the_logged_days_is_named(inputs, spark, tmp_path):
    root = str(tmp_path / "store")
    store.merge_store(spark, root, inputs.messages.filter("channel <> 'ch1' or ts < '2024-01-10'"))
    p = Params(*CURRENT, channels=("ch0", "CH1", "none"))
    parts = report(load(spark, root, p), p, logged=history(spark, root, p))
    checks = {r.check: (r.failed, r.detail) for r in parts["summaries"]["checks"].collect()}
    assert checks["outside_history"] == (True, "ch1") and checks["totals_do_not_add_up"][0] is False


@pytest.mark.parametrize("keep", ["disk", "folder"])
def test_kept_intermediates_change_nothing(inputs, keep):
    p = Params(A, B, channels=("ch0",), sections=preset_sections("standard"))
    shared = bundle.Shared(inputs.messages, inputs.names, keep=keep)
    kept = bundle.chat_stats(inputs.messages, p, inputs.names, shared=shared)
    plain = bundle.chat_stats(inputs.messages, p, inputs.names)
    for name in ("top_chatters", "top_words", "anomalies", "top_emotes"):
        assert rows(kept[name]) == rows(plain[name]), name
    shared.release()


def test_values_of_many_sections_are_planned_one_at_a_time(spark, chat):
    m = chat(("a", "x y", 0), ("b", None, 1), ("a", "x y", 2))
    sections = {f"s{k}": m.groupBy("user_id").agg(F.count("*").alias("n"), F.max("text").alias("t")) for k in range(3)}
    got = bundle.as_values(sections)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" not in plan and plan.count("FileScan parquet") == 1
    one_section = [("n", "1000", 1), ("n", "2000", 1), ("t", "(null)", 1), ("t", "x y", 1), ("user_id", "a", 1), ("user_id", "b", 1)]
    assert rows(got) == sorted((s, *r) for s in sections for r in one_section)


def test_a_kept_table_is_read_by_column(chat):
    kept = checkpointed(chat(("a", "x", 0)))
    plan = kept.select("user_id")._jdf.queryExecution().executedPlan().toString()
    assert rows(kept) == rows(chat(("a", "x", 0))) and "ReadSchema: struct<user_id:string>" in plan


def test_nothing_found_gives_empty_shapes(inputs):
    p = Params(A, B, channels=("ch0",), user="nobody")
    got = bundle.chat_stats(inputs.messages, p, inputs.names)
    assert got["overview"].first().total_messages == 0
    assert got["hourly"].count() == 24 and got["weekday_hour"].count() == 168
    assert got["per_day"].count() == got["top_words"].count() == got["top_chatters"].count() == 0


def test_channel_days_share_one_span(chat):
    day = lambda d: datetime(2024, 1, d, 12)
    m = chat(("a", "x", day(1), {"channel": "one"}), ("a", "x", day(2), {"channel": "two"}), ("a", "x", day(3), {"channel": "one"}))
    days = {}
    for r in sorted(channels.aligned_days(m, ["one", "two", "ghost"]).collect(), key=lambda r: r.day):
        days.setdefault(r.channel, []).append(r.messages)
    assert days == {"one": [1, 0, 1], "two": [0, 1, 0], "ghost": [0, 0, 0]}
    totals = channels.channel_totals(m, ["one", "two", "ghost"])
    pooled = m.groupBy().count().withColumnRenamed("count", "total_messages")
    failed = {r.check: r.detail for r in channels.reconcile(totals, pooled).collect() if r.failed}
    assert failed == {"silent_channels": "ghost"}
    assert {r.channel: r.share_pct for r in channels.channel_share(totals).collect()} == {"one": 66.67, "two": 33.33, "ghost": 0.0}


def periods(chat, now, before):
    day = lambda d, i: datetime(2024, 1, d) + timedelta(minutes=i)
    m = chat(*[(u, "x", day(20, i)) for i, u in enumerate(now)], *[(u, "x", day(10, i)) for i, u in enumerate(before)])
    return compare.label_periods(m, (datetime(2024, 1, 15), datetime(2024, 2, 1)), (datetime(2024, 1, 1), datetime(2024, 1, 15)))


def test_movers(chat):
    both = periods(chat, "aaab", "bbbc")
    assert rows(compare.top_movers(both), "kind", "user_id", "current", "previous", "delta") == [
        ("gain", "a", 3, 0, 3),
        ("loss", "b", 1, 3, -2),
        ("loss", "c", 0, 1, -1),
    ]
    assert compare.top_movers(periods(chat, "aa", "")).count() == 0


def test_deltas(spark):
    table = spark.createDataFrame(
        [(1, 0, 0, "neutral"), (2, 5, 0, "lower-is-better"), (3, 0, 5, "lower-is-better"), (4, 15, 10, "higher-is-better"),
         (5, 5, 10, "higher-is-better"), (6, 5, 10, "neutral"), (7, None, 1, "neutral"), (8, 7, 7, "higher-is-better")],
        "k int, current double, previous double, direction string".replace("double", "int"),
    )
    got = {r.k: (r.delta, r.tone) for r in compare.with_delta(table).collect()}
    assert got == {
        1: ("±0", "flat"), 2: ("new", "bad"), 3: ("gone", "good"), 4: ("▲ 50.0%", "good"), 5: ("▼ 50.0%", "bad"),
        6: ("▼ 50.0%", "flat"), 7: (None, None), 8: ("±0", "flat"),
    }


def test_comparison_needs_a_previous_period(chat):
    assert compare.comparison_table(periods(chat, "aab", "")).count() == 0
    table = {(r.section, r.metric): r for r in compare.comparison_table(periods(chat, "aab", "bc")).collect()}
    assert table["role", "regular"].delta == "▲ 50.0%" and table["platform", "kick"].delta == "±0"
    assert table["quality", "duplicate_message_count"].tone == "bad"
    heads = {r.metric: r for r in compare.headline_table(periods(chat, "aab", "bc")).collect()}
    assert len(heads) == 10 and heads["days_spanned"].delta is None and heads["total_messages"].delta == "▲ 50.0%"


def test_overlay_only_for_equal_lengths(chat):
    assert [r.previous for r in compare.overlay(periods(chat, "aa", "bbb")).collect()] == [3]
    day = lambda d: datetime(2024, 1, d)
    m = chat(("a", "x", day(20)), ("a", "x", day(21)), ("a", "x", day(10)))
    both = compare.label_periods(m, (day(15), day(31)), (day(1), day(15)))
    assert [r.previous for r in compare.overlay(both).collect()] == [None, None]


def test_summary_text(inputs):
    p = Params(A, B, channels=("ch0",))
    text = one(export.summary_text(bundle.chat_stats(inputs.messages, p, inputs.names), "ch0", A, B))
    lines = text.split("\n")
    assert lines[0] == "**ch0** — 2024-03-01 → 2024-03-11" and lines[1].startswith("1,000 messages · 15 chatters")
    assert lines[2].startswith("Top chatter: User") and lines[4].endswith("(5m window)")


STREAMING = {"live_bins", "live_sessions", "ingest_stream"}
WRITING = {"stored_page", "stored_months", "exported_sections", "merged_last_arrival", "raw_files"}


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - STREAMING - WRITING))
def test_plans_have_no_loops_over_pairs_and_little_python(inputs, name):
    plan = REGISTRY[name](inputs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|CartesianProduct|Python", plan)
