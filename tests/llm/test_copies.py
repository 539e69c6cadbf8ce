"""Operators 1 to 3: substring dedup on words and bytes, SimHash groups, against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm_data import DOCS as ODD
from llm_data import found, table  # noqa: F401
from pyspark.sql import functions as F

from parley.llm import simhash, substrings, suffixes
from parley.llm.components import components


def copies(rng, n=40, words=300):
    """Texts that share passages, with edits, and whole copies."""
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(4)]
    out = []
    for i in range(n):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(words))) for _ in range(3)]
        text = f" {rng.choice(passages)}\n".join(parts) if i % 2 else parts[0]
        out.append(text)
        if i % 5 == 0:
            out += [text, text.replace("w7", "w8", 1)]
    return out


def removed_words(texts, width):
    split = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if counts[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def removed_bytes(texts, width):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - width + 1):
            if counts[d[i : i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        flags = np.cumsum(gone[:-1]) > 0
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], flags.astype(int)))) == 1))
        out.append((len(d), int(flags.sum()), spans, bytes(b for b, f in zip(d, flags) if not f)))
    return out


@pytest.mark.parametrize("group_bytes", [2000, 1 << 20])
@pytest.mark.parametrize("width", [5, 35])
def test_words_in_repeated_windows(table, width, group_bytes):
    texts = [*copies(random.Random(width)), *ODD]
    rows = found(substrings.repeated(table(texts, clash=("grp", "kept")), width, group_bytes))
    assert [(r["n_words"], r["n_removed"], r["kept"]) for r in rows] == removed_words(texts, width)
    for r in rows:
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]


def test_repeated_rows_and_null_ids_are_documents_of_their_own(table):
    text = " ".join(f"w{i}" for i in range(50))
    rows = found(substrings.repeated(table([(1, text), (1, text), (None, text), (2, "x " + text[:20])]), 10))
    assert [(r["doc_id"], r["n_removed"]) for r in rows] == [(None, 50), (1, 50), (1, 50), (2, 0)]


@pytest.mark.parametrize("operator,width,plain", [(substrings, 10, removed_words), (suffixes, 200, removed_bytes)])
def test_equal_rows_count_as_often_as_they_come(table, monkeypatch, operator, width, plain):
    monkeypatch.setattr(substrings, "COPIES", 4)
    words = [f"w{i}" for i in range(130)]
    rows = [(1, " ".join(words))] * 11 + [(2, " ".join(words[20:90]) + " and more")] + [(None, None)] * 3 + [(3, "")] * 2 + [(4, " ".join(words[::-1]))]
    for group_bytes in (600, 1 << 20):
        got = found(operator.repeated(table(rows, clash=("part", "copies", "again", "n")), width, group_bytes))
        ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
        want = [(r[0], w[1]) for r, w in zip(ordered, plain([t for _, t in ordered], width))]
        assert [(r["doc_id"], r["n_removed"]) for r in got] == want


def test_many_equal_rows_are_few_documents(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = spark.range(20_000).select(F.lit(7).alias("doc_id"), F.lit(text).alias("text"))
    counted = [(r.doc_id, r.copies, r.again, r.part) for r in substrings.counted_rows(substrings.documents(rows)).collect()]
    assert sorted(counted) == [(7, 10_000, True, 0), (7, 10_000, True, 1)]
    for done in (substrings.repeated(rows, 35), suffixes.repeated(rows, 400)):
        assert [tuple(r) for r in done.groupBy("doc_id", "n_removed").count().collect()] == [(7, 200 if "n_words" in done.columns else len(text), 20_000)]


@pytest.mark.parametrize("operator", [lambda d: substrings.repeated(d, 5), lambda d: suffixes.repeated(d, 200), simhash.groups, simhash.one_of_each])
def test_empty_tables(table, operator):
    assert operator(table([])).count() == 0


@pytest.mark.parametrize("hot", [1, 4096])
@pytest.mark.parametrize("group_bytes", [5000, 1 << 20])
def test_bytes_in_repeated_strings(table, hot, group_bytes):
    texts = [*copies(random.Random(3), n=25, words=120), *ODD, "ab" * 400, "ab" * 300, "é" * 500]
    rows = found(suffixes.repeated(table(texts, clash=("idx",)), 200, group_bytes, hot))
    assert [(r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in rows] == removed_bytes(texts, 200)


def test_who_sends_a_context_does_not_depend_on_the_order_of_arrival():
    pairs = np.array([(5, 1), (5, 2), (9, 4)], suffixes.PAIR)
    sent = [suffixes.hashed(p, grp, 0) for grp, p in ((3, pairs), (1, pairs[:2]), (2, pairs[1:]))]
    ways = [suffixes.judged(suffixes.pa.concat_tables(sent[k] for k in order), 4096) for order in ((0, 1, 2), (2, 1, 0), (1, 2, 0))]
    answers = [dict(zip(t.column("grp").to_pylist(), t.column("data").to_pylist())) for t in ways]
    assert answers[0] == answers[1] == answers[2]
    assert [list(answers[0][g]) for g in (1, 2, 3)] == [[3, 3], [1, 1], [1, 1, 1]]


def test_strings_need_room_for_an_anchor(table):
    with pytest.raises(ValueError):
        suffixes.repeated(table(["x"]), 100)


def test_sorted_strings_and_common_prefixes():
    rng = random.Random(1)
    strings = [bytes(rng.choices(b"\0ab", k=rng.randrange(20))) for _ in range(300)] * 2
    order, common = suffixes.sort_strings(strings, 20)
    assert sorted(order.tolist()) == list(range(600))
    ordered = [strings[i] for i in order]
    for a, b, n in zip(ordered, ordered[1:], common[1:].tolist()):
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert same == n
    assert [s.rstrip(b"\0") for s in ordered] == sorted(s.rstrip(b"\0") for s in strings)


# --- simhash -------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(points, near):
    """The smallest member of each point's component."""
    root = list(range(len(points)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if near(points[i], points[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(points))]


def test_groups_of_fingerprints(table):
    texts = [*copies(random.Random(9)), *ODD, "", "A B", "a b"]
    rows = found(simhash.groups(table(texts, clash=("fp", "mark"))))
    prints = [plain_fingerprint(t) for t in texts]
    assert [r["fingerprint"] for r in rows] == [f"{p:016x}" for p in prints]
    want = classes(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert [r["component_id"] for r in rows] == want and len(set(want)) < len(want)


def test_every_link_shares_an_anchor(spark):
    rng = random.Random(4)
    points = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        points.add(p)
        for _ in range(8):
            points.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))))
    points = sorted(points)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    got = {tuple(x % (1 << 64) for x in r) for r in simhash.links(df).collect()}
    want = {frozenset((a, b)) for i, a in enumerate(points) for b in points[:i] if (a ^ b).bit_count() <= 2}
    assert {frozenset(p) for p in got} == want


def test_replicas_are_not_broadcast(spark, tmp_path):
    """A table of fingerprints under Spark's limit for a broadcast becomes eighty times as many rows."""
    spark.range(4000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fp"))
    got = simhash.links(spark.read.parquet(str(tmp_path / "fp")))
    assert got.count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_code_covers_the_space():
    code = simhash.codewords()
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000, dtype=np.uint32)
    far = np.bitwise_count(words[:, None] ^ code[None, :])
    assert len(set(code.tolist())) == 4096 and far.min(axis=1).max() <= simhash.RADIUS and ((far <= 3).sum(axis=1) == 1).all()


def test_one_of_each_group_stays_whole(table):
    text = " ".join(f"w{i}" for i in range(200))
    docs = table([(5, text), (3, text), (3, text), (None, text), (7, "something else"), (8, None), (9, "")], clash=("own_mark", "mark", "fp", "word", "n"))
    kept = found(simhash.one_of_each(docs))
    assert [(r["doc_id"], r["text"]) for r in kept] == [(3, text), (7, "something else"), (8, None)]
    assert set(kept[0]) == set(docs.columns)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    links += [(200 + i, 201 + i) for i in range(40)] + [(7, 300 + i) for i in range(60)] + [(None, 3), (4, 4)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    nodes = sorted({x for a, b in links if None not in (a, b) and a != b for x in (a, b)})
    real = {frozenset(p) for p in links}
    roots = classes(nodes, lambda a, b: frozenset((a, b)) in real)
    assert got == {n: nodes[r] for n, r in zip(nodes, roots)}


def test_hash_of_a_group_does_not_depend_on_its_order():
    import pyarrow as pa

    rows = [(None, None), (2, "b"), (2, "a"), (1, "c")]
    tables = [pa.table({"doc_id": [r[0] for r in p], "text": [r[1] for r in p]}) for p in (rows, rows[::-1])]
    assert substrings.in_order(tables[0]) == substrings.in_order(tables[1])
