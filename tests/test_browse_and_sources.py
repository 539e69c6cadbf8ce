"""Filters, log browser, ingest, store, coverage, catalogs, exports."""

import hashlib
import json
import random
import re
from datetime import datetime, timedelta

import pytest
from conftest import START, one, rows
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import browse, filters
from parley.plans import export
from parley.sources import catalog, coverage, records, store


def record(i, text="x", when="2024-01-15T10:00:00Z", user="alice", **tags):
    return {
        "type": 1, "text": text, "displayName": user, "timestamp": when, "id": f"m{i}", "username": user,
        "channel": "chan", "raw": "", "tags": {k.replace("_", "-"): v for k, v in tags.items()},
    }


@pytest.fixture
def raw(spark, tmp_path):
    def make(*items, envelope=False):
        path = tmp_path / "in.json"
        path.write_text(json.dumps({"messages": items}) if envelope else "\n".join(map(json.dumps, items)) + "\nnot json\n")
        return records.read_messages(spark, str(path), envelope)

    return make


@pytest.mark.parametrize("envelope", [False, True])
def test_records_become_messages(raw, envelope):
    items = [
        record(1, user_id="7", badges="subscriber/3,moderator/1", emotes="25:0-4"),
        record(2, when="2024-01-15T10:00:00.250"),
        record(3, when="2024-01-15T12:00:00+02:00", user_id="", badges="vipx/1"),
        record(4, when="yesterday"),
        record(5, when="2024-01-15", badges=""),
    ]
    got = records.normalize_messages(raw(*items, envelope=envelope))
    assert rows(got, "id", "ts", "user_id", "role", "emotes_tag") == [
        ("m1", START, "7", "moderator", "25:0-4"),
        ("m2", START + timedelta(milliseconds=250), "alice", "regular", None),
        ("m3", START, "alice", "regular", None),
        ("m5", datetime(2024, 1, 15), "alice", "regular", None),
    ]


def test_parse_ts_does_not_depend_on_the_session_zone(spark, raw):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        items = [record(1), record(2, when="2024-01-15T10:00:00"), record(3, when="2024-01-15T05:00:00-05:00")]
        assert {r[0] for r in rows(records.normalize_messages(raw(*items)), "ts")} == {START}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_room_id_is_the_first_filled_one(raw):
    assert one(records.room_id(raw(record(1, room_id=""), record(2, when="2024-01-15T10:00:01Z", room_id="9")))) == ("chan", "9")


def test_dedupe_keeps_the_last_and_all_without_id(chat):
    ids = ["a", None, "b", "a", None]
    m = chat(*[("u", str(i), i, {"id": x}) for i, x in enumerate(ids, 1)])
    assert [r[0] for r in rows(records.dedupe_by_id(m, [F.col("ts")]), "text")] == ["2", "3", "4", "5"]


def test_browser_filters(raw):
    m = records.normalize_messages(
        raw(
            record(1, "see https://x.de/1 @bob", emotes="1:0-1"),
            record(2, "  !so you", user="Bobby", reply_parent_msg_id="m1"),
            record(3, "plain", first_msg="1", returning_chatter="1"),
            record(4, "PLAIN text", first_msg="0"),
        ),
        keep=("tags",),
    )
    found = lambda **kw: {r[0] for r in rows(filters.filter_messages(m, **kw), "id")}
    assert found() == {"m1", "m2", "m3", "m4"}
    assert found(text=" plain ") == {"m3", "m4"} and found(username="BOB") == {"m2"}
    assert found(url=True) == found(mention=True) == found(number=True) == found(emote=True) == {"m1"}
    assert found(command=True) == found(reply=True) == {"m2"}
    assert found(first_msg=True) == found(returning=True) == {"m3"}
    assert found(min_length=5, max_length=9) == {"m2", "m3"} and found(min_length=0) == {"m1", "m2", "m3", "m4"}
    assert found(text="plain", first_msg=True, max_length=5) == {"m3"}
    tags = dict(rows(m.select("id", F.concat_ws(" ", filters.message_tags()))))
    assert tags == {"m1": "URL @ emote", "m2": "!cmd reply", "m3": "first returning", "m4": ""}
    assert filters.active_filter_count(text=" ", url=True, min_length=0, emote=False) == 2
    with pytest.raises(ValueError):
        filters.active_predicates(nonsense=True)


def test_user_and_window_filters(chat):
    m = chat(("Bob", "x", 0, {"user_id": "1"}), ("bob", "x", 60, {"user_id": "2"}), ("al", "x", 120, {"user_id": "3"}))
    assert filters.filter_user(m, " BOB ").count() == 2 and filters.filter_user(m, "1", "userid").count() == 1
    assert rows(filters.slice_window(m, START, START + timedelta(seconds=60)), "user_id") == [("1",)]


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("limit,offset", [(3, 0), (4, 5), (10, 17), (5, 40)])
def test_pages(chat, reverse, limit, offset):
    m = chat(*[("u", "x", 40 * (i // 2)) for i in range(20)])
    want = [f"m{i:04d}" for i in (reversed(range(20)) if reverse else range(20))][offset : offset + limit]
    assert sorted(r.id for r in browse.page(m, limit, offset, reverse).collect()) == sorted(want)
    with pytest.raises(ValueError):
        browse.page(m, 1001)


def test_browse_queries(chat):
    m = chat(
        ("Old", "hello", 0, {"user_id": "1", "channel": "A1"}),
        ("New", "HELLO you", 86400, {"user_id": "1", "channel": "A1"}),
        ("Zed", "x", 40 * 86400, {"user_id": "2", "channel": "b2"}),
    )
    assert rows(browse.available_days(m, "A1")) == [("A1", 2024, 1, 15), ("A1", 2024, 1, 16)]
    assert rows(browse.name_history(m, "1"), "user_login") == [("New",), ("Old",)]
    assert one(browse.user_stats(m, "A1", "1", "userid")) == ("1", "New", 2)
    assert one(browse.channel_stats(m, "A1")) == 2
    assert rows(browse.search(m, "A1", "1", "hello", "userid"), "id") == [("m0000",), ("m0001",)]
    assert rows(browse.channel_logs_on(m, "A1", "2024-01-16"), "id") == [("m0001",)]
    assert rows(browse.user_logs_in(m, "b2", "zed", "2024-02"), "id") == [("m0002",)]
    assert rows(browse.suggest_channels(m, "1")) == [("A1",)] and rows(browse.suggest_channels(m, taken=["a1 "])) == [("b2",)]
    draw = rows(browse.random_channel(m, "A1", 1, seed=3), "id")
    assert draw == rows(browse.random_channel(m, "A1", 1, seed=3), "id") and len(draw) == 1


def test_overlapping_pages_merge(chat):
    a = chat(("u", "x", 0), ("u", "x", 1, {"id": None}), ("u", "y", 1, {"id": ""}))
    assert browse.merge_pages(a, a).count() == 3
    edited = a.filter("id = 'm0000'").withColumn("text", F.lit("edited"))
    assert [r.text for r in browse.merge_pages(a, edited).collect()] == ["edited", "x", "y"]


def test_pages_merge_as_one_ranking_by_id_does(chat):
    rng = random.Random(3)
    draw = lambda: (rng.choice("uv"), rng.choice(["x", "y", None]), rng.randrange(3), {"id": rng.choice([None, "", "a", "b", "c", "d"])})
    for n in (2, 12):
        pages = [[draw() for _ in range(n)] for _ in range(3)]
        frames = [chat(*p).withColumn("ts", F.when(F.minute("ts") * 60 + F.second("ts") > 0, F.col("ts"))) for p in pages]
        got = browse.merge_pages(*frames).collect()
        best = {}
        for place, frame in enumerate(frames):
            for r in frame.collect():
                digest = hashlib.sha256(r.text.encode()).digest() if r.text is not None else b""
                rank = (place, r.ts is not None, r.ts or START, [-b for b in digest] or [1])
                key = (r.id,) if r.id else (r.username, r.text, r.ts)
                if key not in best or rank > best[key][0]:
                    best[key] = rank, r
        want = [r for _, r in best.values()]
        plain = lambda rs: sorted(((r.id or r.username, r.ts, r.text) for r in rs), key=str)
        assert plain(got) == plain(want)
        order = [(r.ts is not None, r.ts or START, r.id is not None, r.id or "") for r in got]
        assert order == sorted(order) and got and "__place" not in got[0]


def test_pages_merge_shuffles_texts_once(spark, chat):
    day = chat(("u", "x", 0), ("u", "y", 1))
    merged = browse.merge_pages(day, day)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    texts = [line for line in plan.splitlines() if "Exchange" in line]
    assert sum("rangepartitioning" in line for line in texts) == 1 and len(texts) == 2  # the other one has ids and times


def test_a_draw_does_not_prefer_messages_without_id(chat):
    m = chat(*[("u", f"t{i}", i, {"id": None} if i < 2 else {}) for i in range(20)])
    drawn = [{r.text for r in browse.random_channel(m, " CHAN", 2, seed=s).collect()} for s in range(6)]
    assert any(d != {"t0", "t1"} for d in drawn) and len({frozenset(d) for d in drawn}) > 1


def test_store_merges_are_idempotent_and_pruned(spark, chat, tmp_path):
    root = str(tmp_path / "store")
    m = chat(*[("u", f"t{i}", datetime(2024, 9, 1, 12) + timedelta(days=i)) for i in range(35)], channel="Chan One")
    read = lambda a, b: store.read_store(spark, root, ["chan one"], a, b)
    assert read(datetime(2024, 9, 1), datetime(2024, 11, 1)).count() == 0
    for part in (m, m, m.filter(F.col("id") == "m0003").withColumn("text", F.lit("edited"))):
        store.merge_store(spark, root, part)
    everything = read(datetime(2024, 9, 1), datetime(2024, 11, 1))
    assert everything.count() == 35 and one(everything.filter("id = 'm0003'"), "text") == "edited"
    cut = read(datetime(2024, 10, 2, 12), datetime(2024, 10, 4, 12))
    assert rows(cut, "id") == [("m0031",), ("m0032",)]
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    scan = cut._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "year_month#" in scan.split("PartitionFilters: ")[1].split("PushedFilters: ")[0]
    assert "GreaterThanOrEqual(ts" in scan.split("PushedFilters: ")[1]


def test_a_reader_keeps_its_version_and_a_merge_that_dies_shows_nothing(spark, chat, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    old = chat(*[("u", "old", day(n)) for n in range(60)])
    store.merge_store(spark, root, old)
    reader, whole = store.read_store(spark, root, "chan", day(0), day(90)), rows(old, "id", "text")
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            store.merge_store(spark, root, old.withColumn("text", F.lit("half")))
    assert rows(store.scan(spark, root), "id", "text") == whole
    store.merge_store(spark, root, old.filter("id < 'm0040'").withColumn("text", F.lit("new")))
    assert rows(reader, "id", "text") == whole
    texts = dict(rows(store.scan(spark, root), "id", "text"))
    assert len(texts) == 60 and {i for i, t in texts.items() if t == "new"} == {f"m{n:04d}" for n in range(40)}
    first = store.snapshot(spark, root, 1)
    assert rows(store.scan(spark, root, first), "id", "text") == whole
    assert store.vacuum(spark, root, keep=1) == 2 and rows(store.scan(spark, root), "id") == rows(old, "id")
    assert store.versions(spark, root) == [2]


def test_of_two_merges_at_once_the_second_is_refused(spark, chat, tmp_path, monkeypatch):
    root, real = str(tmp_path / "store"), store.snapshot
    store.merge_store(spark, root, chat(("u", "a", 0)))
    seen = real(spark, root)
    store.merge_store(spark, root, chat(("u", "b", 0)))
    monkeypatch.setattr(store, "snapshot", lambda *a: seen)
    with pytest.raises(store.MergeConflict):
        store.merge_store(spark, root, chat(("u", "c", 0)))
    monkeypatch.undo()
    assert rows(store.scan(spark, root), "text") == [("b",)] and store.versions(spark, root) == [1, 2]


def test_store_takes_messages_without_time_or_channel_and_empty_merges(spark, chat, tmp_path):
    root = str(tmp_path / "store")
    odd = chat(("u", "x", 0), ("u", "y", 1), ("u", "z", 2)).withColumn("ts", F.when(F.col("text") != "y", F.col("ts")))
    odd = odd.withColumn("channel", F.when(F.col("text") != "z", F.col("channel")))
    for _ in range(2):
        store.merge_store(spark, root, odd)
        store.merge_store(spark, root, odd.limit(0))
        assert rows(store.scan(spark, root), "text") == [("x",), ("y",), ("z",)]
    assert sum(r.messages for r in store.minutes(spark, root, "chan").collect()) == 1


def test_without_an_arrival_the_order_of_rows_does_not_count(spark, chat, tmp_path):
    copies = chat(("u", "b", 0, {"id": "x"}), ("u", "a", 0, {"id": "x"}), ("u", "c", 0, {"id": "x"}))
    kept = set()
    for k, part in enumerate((copies, copies.orderBy("text"), copies.orderBy(F.desc("text")))):
        store.merge_store(spark, str(tmp_path / str(k)), part)
        kept.add(one(store.scan(spark, str(tmp_path / str(k))), "text"))
    assert len(kept) == 1


@pytest.mark.parametrize("reverse", [False, True])
def test_stored_pages_equal_pages_and_read_their_minutes_only(spark, chat, tmp_path, reverse):
    root = str(tmp_path / "store")
    m = chat(*[("u", f"t{n}", datetime(2024, 1, 25) + timedelta(hours=n % 400, seconds=n % 7)) for n in range(900)])
    store.merge_store(spark, root, m.filter("id < 'm0500'"))
    store.merge_store(spark, root, m.filter("id >= 'm0450'"))
    for limit, offset in ((1, 0), (10, 0), (50, 400), (1000, 0), (7, 896), (5, 900), (5, 5000)):
        got = browse.stored_page(spark, root, "CHAN", limit, offset, reverse)
        want = browse.channel_logs(m, "chan", limit=limit, offset=offset, reverse=reverse)
        assert [r.id for r in got.collect()] == [r.id for r in want.collect()], (limit, offset)
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = browse.stored_page(spark, root, "chan", 5, 100, reverse)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert plan.count("FileScan parquet") <= 2 and "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    with pytest.raises(ValueError):
        browse.stored_page(spark, root, "chan", 0)
    assert browse.stored_page(spark, str(tmp_path / "none"), "chan").count() == 0


def test_the_last_arrived_copy_stays_and_the_stage_is_removed(spark, chat, tmp_path):
    root, stage = str(tmp_path / "store"), tmp_path / "stage"
    m = chat(("u", "zzz first", 0, {"id": "a"}), ("u", "aaa last", 0, {"id": "a"}))
    came = m.withColumn("came", F.when(F.col("text") == "aaa last", 2).otherwise(1))
    store.merge_store(spark, root, came, arrival="came", stage=str(stage))
    assert rows(store.scan(spark, root), "text") == [("aaa last",)]
    store.merge_store(spark, root, came.withColumn("came", -F.col("came")), arrival="came", stage=str(stage))
    assert rows(store.scan(spark, root), "text") == [("zzz first",)]
    assert list(stage.iterdir()) == []


def test_only_repeated_ids_are_put_in_order(spark, chat):
    m = chat(*[("u", f"t{n}", n, {"id": f"i{n // 2 if n < 20 else n}"}) for n in range(60)])
    m = m.unionByName(m.limit(3).withColumn("id", F.lit(None).cast("string")).withColumn("text", F.lit("same")))
    order = [F.col("ts"), F.col("text")]
    got = records.dedupe_repeated(m, order)
    assert rows(got) == rows(records.dedupe_by_id(m, order)) and got.count() == 53
    through, real = [], records.dedupe_by_id
    records.dedupe_by_id = lambda df, *a: through.append(df.filter("id is not null").count()) or real(df, *a)
    try:
        records.dedupe_repeated(m, order)
    finally:
        records.dedupe_by_id = real
    assert 20 <= through[0] < 25


@pytest.mark.parametrize("at_once", [1, 20, 1 << 25])
def test_a_merge_copies_rows_and_shuffles_no_texts(spark, chat, tmp_path, monkeypatch, at_once):
    root, plans, real = str(tmp_path / "store"), [], store._write
    monkeypatch.setattr(store, "COPIED_ROWS", at_once, raising=False)

    def write(rows, path, *more):
        if "/data/" in path:
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        real(rows, path, *more)

    monkeypatch.setattr(store, "_write", write)
    want, nameless = {}, []
    for k in range(3):
        told = [(f"i{n % (7 + 30 * k)}" if n % 5 else None, f"t{k} {n * 37 % 11}", datetime(2024, 1, 1) + timedelta(days=n * 13 % 90)) for n in range(60)]
        m = chat(*[("u", text, at, {"id": i, "channel": f"c{n % 2}"}) for n, (i, text, at) in enumerate(told)])
        store.merge_store(spark, root, m.repartition(5))
        nameless += [(None, text) for i, text, _ in told if i is None]
        key = {t: h for t, h in rows(m.select("text", tx.text_key("text")))}
        new = {i: max((at, bytes(key[text]), text) for j, text, at in told if j == i) for i in {i for i, _, _ in told} - {None}}
        want |= {i: text for i, (_, _, text) in new.items()}
    assert rows(store.scan(spark, root), "id", "text") == sorted([*nameless, *want.items()], key=str)
    assert not any(re.search(r"Exchange (hash|range|Round|rebalance)|[Rr]ebalance|Window", plan) for plan in plans) and len(plans) >= 3


def test_unreadable_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "text": "x"}\nnot json\n\n{"id": "2", "te')
    assert records.read_messages(spark, str(tmp_path)).count() == len(records.read_messages(spark, str(tmp_path)).collect()) == 1
    assert rows(records.unreadable_lines(spark, str(tmp_path))) == [("not json",), ('{"id": "2", "te',)]


def test_merging_one_month_leaves_the_others(spark, chat, tmp_path):
    root = str(tmp_path / "store")
    store.merge_store(spark, root, chat(("u", "a", datetime(2024, 1, 5)), ("u", "b", datetime(2024, 2, 5))))
    store.merge_store(spark, root, chat(("u", "c", datetime(2024, 2, 6), {"id": "new"})))
    assert rows(store.scan(spark, root), "text", "year_month") == [("a", "2024_01"), ("b", "2024_02"), ("c", "2024_02")]


def test_merging_a_month_that_the_store_does_not_have(spark, chat, tmp_path):
    root = str(tmp_path / "store")
    for month in (1, 2, 1):
        store.merge_store(spark, root, chat(("u", f"t{month}", datetime(2024, month, 5), {"id": f"i{month}"})))
    assert rows(store.scan(spark, root), "id", "text", "year_month") == [("i1", "t1", "2024_01"), ("i2", "t2", "2024_02")]


def hours(*pairs):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    return [("k", at(a), at(b)) for a, b in pairs]


@pytest.fixture
def spans(spark):
    return lambda *pairs: spark.createDataFrame(hours(*pairs), "channel_key string, cov_from timestamp_ntz, cov_to timestamp_ntz")


@pytest.fixture
def need(spark):
    def make(a, b, fetched=None, stale=False):
        (key, low, high), at = hours((a, b))[0], datetime(2024, 1, 1)
        done = None if fetched is None else at + timedelta(hours=fetched)
        return spark.createDataFrame(
            [(key, low, high, done, stale)],
            "channel_key string, need_from timestamp_ntz, need_to timestamp_ntz, fetched_at timestamp_ntz, stale boolean",
        )

    return make


def in_hours(df):
    zero = datetime(2024, 1, 1)
    return sorted(tuple((t - zero).total_seconds() / 3600 for t in r[1:3]) for r in rows(df))


@pytest.mark.parametrize(
    "stored,merged",
    [
        ([(0, 2), (1, 3)], [(0, 3)]),
        ([(0, 2), (2, 3)], [(0, 3)]),
        ([(4, 5), (0, 1)], [(0, 1), (4, 5)]),
        ([(0, 9), (1, 2), (3, 4)], [(0, 9)]),
        ([(3, 3)], []),
    ],
)
def test_coverage_merge(spans, stored, merged):
    assert in_hours(coverage.merge(spans(*stored))) == merged


@pytest.mark.parametrize(
    "stored,wanted,missing",
    [
        ([], (2, 8), [(2, 8)]),
        ([(0, 9)], (2, 8), []),
        ([(3, 4), (6, 7)], (2, 8), [(2, 3), (4, 6), (7, 8)]),
        ([(0, 3), (7, 12)], (2, 8), [(3, 7)]),
        ([(0, 2), (8, 9)], (2, 8), [(2, 8)]),
    ],
)
def test_coverage_gaps(spans, need, stored, wanted, missing):
    gaps = coverage.gaps(spans(*stored), need(*wanted))
    assert in_hours(gaps) == missing
    assert coverage.covers(spans(*stored), need(*wanted)).first().covered == (missing == [])


def test_refresh_plan(spans, need):
    sixth = 10 / 60
    plan = lambda stored, *n, **kw: [
        tuple(round(x, 3) for x in p) for p in in_hours(coverage.refresh_plan(spans(*stored), need(*n), **kw))
    ]
    near = lambda *pairs: [tuple(round(x, 3) for x in p) for p in pairs]
    assert plan([], 0, 24) == [(0, 24)]
    assert plan([(0, 24)], 0, 24, 30, False) == []
    assert plan([(0, 24)], 0, 24, 30, True) == []
    assert plan([(0, 24)], 0, 24, 20, True) == near((20 - sixth, 24))
    assert plan([(2, 10)], 0, 24, 30, False) == near((0, 2 + sixth), (10 - sixth, 24))
    assert plan([(0, 10), (12, 24)], 0, 24, 20, True) == near((10 - sixth, 12 + sixth), (20 - sixth, 24))
    assert plan([(0, 20)], 0, 24, 20, True) == near((20 - sixth, 24))
    assert plan([(0, 24)], 0, 24, 30, False, force=True) == [(0, 24)]


def test_a_cut_off_span_covers_up_to_its_last_message(spark):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    done = spark.createDataFrame(
        [("k", at(0), at(5), False, at(1)), ("k", at(5), at(9), True, at(7)), ("k", at(9), at(12), True, None)],
        "channel_key string, span_from timestamp_ntz, span_to timestamp_ntz, truncated boolean, max_ts timestamp_ntz",
    )
    assert in_hours(coverage.merge(coverage.after_fetch(done))) == [(0, 7)]


def test_months_and_states(spark, need):
    months = coverage.months_in(need(0, 24 * 60))
    assert [r[0] for r in rows(months, "year_month")] == ["2024_01", "2024_02", "2024_03"]
    now = F.lit("2024-03-01 00:30:00").cast("timestamp_ntz")
    table = months.withColumns(
        {"fetched_at": now - F.expr("interval 20 minutes"), "truncated": F.lit(False), "covered": F.lit(True)}
    )
    state = rows(coverage.month_state(table, now), "year_month", "immutable", "stale", "complete")
    assert state == [("2024_01", True, False, True), ("2024_02", False, True, True), ("2024_03", False, True, True)]


def test_provider_payloads(spark, tmp_path):
    shapes = {
        "7tv": {"emote_set": {"emotes": [{"id": "1", "name": "A"}, {"id": "9"}]}},
        "bttv": {"channelEmotes": [{"id": "2", "code": "B"}], "sharedEmotes": [{"id": "1", "code": "A2"}]},
        "ffz": {"sets": {"5": {"emoticons": [{"id": 3, "name": "C"}]}, "6": {"emoticons": [{"id": 4, "name": "D"}]}}},
    }
    table = None
    for provider, doc in shapes.items():
        file = tmp_path / f"{provider}.json"
        file.write_text(json.dumps(doc, indent=1))
        part = catalog.read_payloads(spark, str(file), "chan", provider)
        table = part if table is None else table.unionByName(part)
    assert rows(catalog.emote_catalog(table), "emote_id", "name") == [("1", "A2"), ("2", "B"), ("3", "C"), ("4", "D")]
    two = spark.createDataFrame([("a", "1", "X"), ("b", "1", "Y"), ("a", "2", "Z")], "channel string, emote_id string, name string")
    assert rows(catalog.catalog_union(two, ["a", "b"])) == [("1", "Y"), ("2", "Z")]


def test_text_functions(spark):
    value = lambda column: spark.range(1).select(column).first()[0]
    assert value(tx.clean_text(F.lit("hey @alice check https://example.com/x KEEP"))) == "hey   check   keep"
    assert value(tx.channel_key(F.lit(" Ab-c "))) == "channel_ab_c"
    assert value(tx.strip_end(F.lit("a b  \t\n"))) == "a b"
    assert value(tx.domain_of(F.lit("https://www.example.com?x=1/y"))) == "example.com?x=1"
    assert value(tx.urls(F.lit("a https://x.de/1 b"))) == ["https://x.de/1"]
    assert value(tx.role_of(F.lit("vip/1,broadcaster/1"))) == "broadcaster"
    assert value(tx.char_len(F.lit("😀a"))) == 2
    assert value(tx.ellipsis(F.lit("x" * 300))) == "x" * 300


def test_sections_are_written_in_one_pass_with_their_order_and_line_ends(spark, tmp_path):
    words = spark.createDataFrame([("b,c", 2), ('q"x', 9), ("a\nb", 2), ("plain", 5)], "word string, uses long")
    days = spark.createDataFrame([(datetime(2024, 1, 2).date(), 3), (datetime(2024, 1, 1).date(), 4)], "day date, messages long")
    empty = spark.createDataFrame([], "url string, uses long")
    sections = {"top_words": words, "per_day": days, "top_urls": empty, "overview": words}
    assert export.write_sections(sections, str(tmp_path / "out"), "base") == ["top_words", "top_urls", "per_day"]
    text = {f.parent.name: f.read_bytes().decode() for f in (tmp_path / "out").glob("*/*.txt")}
    assert text == {
        "section=base_top_words": 'word,uses\r\n"q""x",9\r\nplain,5\r\n"a\nb",2\r\n"b,c",2\r\n',
        "section=base_top_urls": "url,uses\r\n",
        "section=base_per_day": "day,messages\r\n2024-01-01,4\r\n2024-01-02,3\r\n",
    }
    back = export.read_section(spark, str(tmp_path / "out"), "top_words", "base")
    assert rows(back) == sorted([("b,c", "2"), ('q"x', "9"), ("a\nb", "2"), ("plain", "5")], key=str)
    export.write_csv(words, str(tmp_path / "one"))
    assert all(f.read_bytes().endswith(b"\r\n") for f in (tmp_path / "one").glob("*.csv"))


def test_exports(spark, chat, tmp_path):
    m = chat(("a,b", 'say "hi"', 0), ("c", "x", 61))
    export.write_csv(m.select("username", "text", "ts"), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert ("a,b", 'say "hi"', "2024-01-15T10:00:00.000000+00:00") in rows(back)
    assert export.base_name("a/b", "2024-01-01T00:00", "2024-02-01") == "a_b_2024-01-01_2024-02-01"
    export.export_messages(m, str(tmp_path / "txt"), as_text=True)
    assert rows(spark.read.text(str(tmp_path / "txt")))[0] == ('[2024-01-15T10:00:00.000Z] a,b: say "hi"',)
    export.write_json({"messages": m}, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
