"""Streams over files compared with the batch operators."""

import json
import os
from datetime import timedelta

import pytest
from conftest import START, rows

from parley.operators import sessions, temporal
from parley.sources import records, store
from parley.streaming import live


@pytest.fixture
def files(tmp_path):
    """Six files of one day; the last but one repeats rows, and one holds a row that is hours late."""
    folder = tmp_path / "in"
    folder.mkdir()
    sent = []
    for part in range(6):
        batch = []
        for i in range(40):
            n = part * 40 + i
            when = START + timedelta(seconds=n * 97)
            batch.append(
                {"id": f"m{n}", "text": f"t{n}", "username": f"u{n % 7}", "channel": "chan", "tags": {}, "timestamp": when.isoformat() + "Z"}
            )
        sent += batch
        extra = sent[-45:-40] if part == 4 else []
        (folder / f"{part}.json").write_text("\n".join(json.dumps(r) for r in [*batch, *extra]))
        os.utime(folder / f"{part}.json", (1_700_000_000 + part,) * 2)  # files are taken in order of their time
    return folder


@pytest.fixture
def late(files):
    row = {"id": "late", "text": "x", "username": "u1", "channel": "chan", "tags": {}, "timestamp": START.isoformat() + "Z"}
    with (files / "5.json").open("a") as f:
        f.write("\n" + json.dumps(row))
    return files


def finish(spark, table, root, partitions=()):
    live.write_stream(table, f"{root}/out", f"{root}/checkpoint", partitions).awaitTermination()
    return spark.read.schema(table.schema).parquet(f"{root}/out")


def messages(spark, folder):
    return live.read_stream(spark, str(folder), files_per_batch=1)


def test_ingest_drops_repeats_and_lands_in_the_store_layout(spark, files, tmp_path):
    got = finish(spark, live.ingest_stream(messages(spark, files)), tmp_path, store.PARTITIONS)
    assert got.count() == 240 and got.select("id").distinct().count() == 240
    assert rows(got.select("channel_key", "year_month").distinct()) == [("channel_chan", "2024_01")]


def test_bins_equal_the_batch_up_to_the_watermark(spark, late, tmp_path):
    got = rows(finish(spark, live.live_bins(live.deduplicated(messages(spark, late)).filter("id <> 'late'")), tmp_path), "window_start", "message_count")
    batch = records.normalize_messages(records.read_messages(spark, str(late))).filter("id <> 'late'").dropDuplicates(["id"])
    closed = START + timedelta(seconds=239 * 97) - timedelta(minutes=10)
    want = [r for r in rows(temporal.bins_5m(batch), "window_start", "message_count") if r[0] + timedelta(minutes=5) <= closed]
    assert got == want


def test_late_rows_are_not_counted(spark, late, tmp_path):
    bins = dict(rows(finish(spark, live.live_bins(messages(spark, late)), tmp_path), "window_start", "message_count"))
    assert bins[START] == 4


def test_sessions_equal_the_batch(spark, files, tmp_path):
    stream = live.deduplicated(messages(spark, files))
    got = rows(finish(spark, live.live_sessions(stream, 11), tmp_path))
    batch = records.normalize_messages(records.read_messages(spark, str(files))).dropDuplicates(["id"])
    table = sessions.session_table(batch, 11)
    closed = START + timedelta(seconds=239 * 97) - timedelta(minutes=21)
    want = [r for r in rows(table, "user_id", "session_start", "session_end", "messages") if r[2] <= closed]
    assert got == want and got


def test_live_refresh_can_be_stopped(spark, files, tmp_path):
    query = live.live_refresh(live.ingest_stream(messages(spark, files)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert "900000" in str(query._jsq) or query.isActive
    query.stop()
    assert not query.isActive


def test_bins_that_are_still_open_are_read_too(spark, tmp_path):
    from pyspark.sql import functions as F

    rows_in = [("u", f"2024-01-01 10:{m:02d}:00") for m in (1, 2, 7, 8, 9, 14)]
    for k, part in enumerate((rows_in[:4], rows_in[4:])):
        made = spark.createDataFrame(part, "user_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
        table = live.live_bins(stream)
        live.write_windows(table, str(tmp_path / "bins"), str(tmp_path / "check")).awaitTermination()
    got = live.read_windows(spark, str(tmp_path / "bins"), table)
    assert {r.window_start.minute: r.message_count for r in got.collect()} == {0: 2, 5: 3, 10: 1}


def test_late_and_repeated_rows_end_up_in_the_store(spark, late, tmp_path):
    root, check = str(tmp_path / "store"), str(tmp_path / "check")
    live.ingest_into_store(messages(spark, late), root, check).awaitTermination()
    batch = records.normalize_messages(records.read_messages(spark, str(late))).dropDuplicates(["id"])
    assert rows(store.scan(spark, root), *batch.columns) == rows(batch) and len(rows(batch)) == 241
    assert store.snapshot(spark, root).batches == {check: 5}
    # more files, taken up where the stream stopped
    row = {"id": "more", "text": "x", "username": "u1", "channel": "chan", "tags": {}, "timestamp": "2023-12-31T00:00:00Z"}
    (late / "6.json").write_text(json.dumps(row))
    live.ingest_into_store(messages(spark, late), root, check).awaitTermination()
    assert store.scan(spark, root).count() == 242 and store.snapshot(spark, root).batches == {check: 6}


def test_a_batch_that_is_repeated_changes_nothing(spark, chat, tmp_path):
    root = str(tmp_path / "store")
    first, second = chat(("a", "one", 0)), chat(("a", "two", 0))
    assert store.merge_store(spark, root, first, batch=("s", 0))
    assert not store.merge_store(spark, root, second, batch=("s", 0))
    assert rows(store.scan(spark, root), "text") == [("one",)] and store.versions(spark, root) == [1]
    assert store.merge_store(spark, root, second, batch=("other", 0)) and store.merge_store(spark, root, first, batch=("s", 1))
    assert rows(store.scan(spark, root), "text") == [("one",)]
    assert store.snapshot(spark, root).batches == {"s": 1, "other": 0}


def test_a_merge_that_is_overtaken_is_tried_again(spark, files, tmp_path, monkeypatch):
    root, real, refused = str(tmp_path / "store"), store.merge_store, []

    def merge(*args):
        if len(refused) < 2:
            refused.append(args[-1])
            raise store.MergeConflict
        return real(*args)

    monkeypatch.setattr(store, "merge_store", merge)
    live.ingest_into_store(messages(spark, files), root, str(tmp_path / "check")).awaitTermination()
    assert store.scan(spark, root).count() == 240 and len(refused) == 2


def test_live_bins_equal_the_batch_table(spark, late, tmp_path):
    sent = records.normalize_messages(records.read_messages(spark, str(late)))
    for _ in range(2):  # a second call finds nothing new
        live.write_bins(messages(spark, late), str(tmp_path / "bins"), str(tmp_path / "check")).awaitTermination()
        got = live.read_bins(spark, str(tmp_path / "bins"))
        columns = ("window_start", "message_count", "unique_chatters")
        assert rows(got, *columns) == rows(temporal.bins_5m(sent), *columns)


def test_live_sessions_equal_the_batch_table(spark, late, tmp_path):
    sent = records.normalize_messages(records.read_messages(spark, str(late)))
    columns = ("user_id", "session_start", "session_end", "messages", "duration_s")
    for gap in (11, 12):
        root = tmp_path / str(gap)
        live.write_sessions(messages(spark, late), str(root / "out"), str(root / "check"), gap).awaitTermination()
        assert rows(live.read_sessions(spark, str(root / "out"), gap), *columns) == rows(sessions.session_table(sent, gap), *columns)


def test_a_pause_of_exactly_the_gap_splits_and_parts_are_put_together(spark, chat, tmp_path):
    times = [0, 600, 1199, 1200, 1799, 3000]  # a gap of ten minutes: 600, then 599, 1, 599, 1201 seconds
    for k, second in enumerate(reversed(times)):
        chat(("u", "x", second)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(chat(("u", "x", 0)).schema).parquet(str(tmp_path / "in"))
        live.write_sessions(stream, str(tmp_path / "out"), str(tmp_path / "check"), 10).awaitTermination()
        batch = spark.read.parquet(str(tmp_path / "in"))
        columns = ("user_id", "session_start", "session_end", "messages")
        assert rows(live.read_sessions(spark, str(tmp_path / "out"), 10), *columns) == rows(sessions.session_table(batch, 10), *columns)
    assert sorted(r.messages for r in live.read_sessions(spark, str(tmp_path / "out"), 10).collect()) == [1, 1, 4]


def test_nothing_sent_is_nothing_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = messages(spark, tmp_path / "in")
    live.write_bins(stream, str(tmp_path / "bins"), str(tmp_path / "c1")).awaitTermination()
    live.write_sessions(stream, str(tmp_path / "sessions"), str(tmp_path / "c2")).awaitTermination()
    assert live.read_bins(spark, str(tmp_path / "bins")).count() == 0
    assert live.read_sessions(spark, str(tmp_path / "sessions")).count() == 0
