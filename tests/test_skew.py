"""One user, text or mentioned name with a third of all rows, against plain Python."""

import hashlib
import random
from datetime import timedelta

import pytest
from conftest import START, one, rows
from pyspark.sql import functions as F

from parley.operators import bots, health, mentions, sessions
from parley.schema import MESSAGES


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    out = []
    for i in range(3000):
        hot = rng.random() < 0.4
        user = "hot" if hot else f"u{rng.randrange(60)}"
        text = "raid" if rng.random() < 0.4 else rng.choice(["a", "b", f"t{i}"])
        if rng.random() < 0.3:
            text = f"@{rng.choice(['HOT', 'u1', 'u2', 'u59'])} {text}"
        ts = START + timedelta(milliseconds=rng.choice([0, rng.randrange(999)]), seconds=rng.randrange(40_000))
        out.append((f"m{i:05d}", ts, user, user, text, None, "regular", f"c{rng.randrange(2)}"))
    return sorted(out, key=lambda r: (r[1], r[0]))


@pytest.fixture(scope="module")
def m(spark, data):
    return spark.createDataFrame(data, MESSAGES).cache()


def whole(later, earlier):
    return int((later - earlier) / timedelta(seconds=1))


def by_user(data):
    users = {}
    for r in data:
        users.setdefault(r[2], []).append(r)
    return users


@pytest.mark.parametrize("gap", [2, 15, 120])
def test_sessions(m, data, gap):
    want = []
    for user, mine in by_user(data).items():
        start = last = None
        for r in mine:
            if last is None or whole(r[1], last) >= gap * 60:
                want.append([user, 0, r[1], r[1]])
            want[-1][1] += 1
            want[-1][3] = last = r[1]
    got = sessions.session_table(m, gap)
    assert rows(got, "user_id", "messages", "session_start", "session_end") == sorted(map(tuple, want), key=str)


@pytest.mark.parametrize("cell", ["1 minute", "1 hour", "10 seconds"])
def test_self_repetition(m, data, cell):
    want = sum(a[4] == b[4] for mine in by_user(data).values() for a, b in zip(mine, mine[1:]))
    assert one(health.self_repetition(m, cell=cell), "self_repetition_count") == want


@pytest.mark.parametrize("cell", ["1 minute", "1 hour"])
def test_gap_deviation(m, data, cell):
    got = {r.user_id: (r.messages, r.gap_std) for r in bots.gap_statistics(m, cell=cell).collect()}
    for user, mine in by_user(data).items():
        gaps = [whole(b[1], a[1]) for a, b in zip(mine, mine[1:])]
        assert got[user][0] == len(mine)
        if len(gaps) > 1:
            mean = sum(gaps) / len(gaps)
            std = (sum((g - mean) ** 2 for g in gaps) / (len(gaps) - 1)) ** 0.5
            assert got[user][1] == pytest.approx(std, rel=1e-9, abs=1e-9)
        else:
            assert got[user][1] is None


@pytest.mark.parametrize("cell", ["1 minute", "1 hour"])
@pytest.mark.parametrize("window", [5, 60, 7200])
def test_copy_paste(m, data, cell, window):
    texts = {}
    for r in data:
        texts.setdefault(r[4], []).append(r)
    want = []
    for text, uses in texts.items():
        pairs = [(a, b) for a, b in zip(uses, uses[1:]) if a[2] != b[2] and whole(b[1], a[1]) <= window]
        if len(uses) >= 3 and pairs:
            want.append((hashlib.sha256(text.encode()).hexdigest(), len(uses), len(pairs), len({x[2] for p in pairs for x in p})))
    got = health.copy_paste_events(m, window_s=window, cell=cell)
    got = got.withColumn("text", F.lower(F.hex("text_key")))
    assert rows(got, "text", "uses", "occurrences", "distinct_users") == sorted(want, key=str)


@pytest.mark.parametrize("window", [1, 300, 5000])
def test_replies(m, data, window):
    import re

    want = []
    for i, r in enumerate(data):
        for name in re.findall(r"\B@(\w+)", r[4]):
            target = name.lower()
            if target == r[2]:
                continue
            past = [x[1] for x in data if x[2] == target and x[1] <= r[1]]
            if past and whole(r[1], max(past)) <= window:
                want.append((r[2], target, r[1], max(past)))
    assert rows(mentions.replies(m, window_s=window)) == sorted(want, key=str)


@pytest.mark.parametrize("by", [[], ["channel"]])
def test_copies_of_a_text_meet_by_cell_only(spark, m, by):
    """No task gets all rows of the raid text, so nothing is joined or dealt by the text alone before cells are counted."""
    odd = spark.createDataFrame([(f"x{i}", START + timedelta(seconds=i), f"u{i % 2}", "u", None, None, "regular", "c0") for i in range(6)], MESSAGES)
    events = health.copy_paste_events(m.unionByName(odd), by)
    assert events.filter("text_key is null").count() == 0 and events.count() > 0
    assert "Join" not in events._jdf.queryExecution().optimizedPlan().toString()
