"""The near-dedup stage of the pipeline against plain Python."""

import random

from llm_data import DOCS as ODD
from llm_data import found, table  # noqa: F401
from test_copies import classes

import corpus_pipeline
from parley.llm import near_copies, simhash


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def edited(rng, words, k):
    out = list(words)
    for at in rng.sample(range(len(words)), k):
        out[at] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


def texts_with_near_copies(rng):
    """Families of (words, replaced words per copy): similarities around 0.9, 0.82 and below 0.7."""
    out = []
    for words, replaced in ((100, 1), (100, 2), (300, 3), (300, 6), (1000, 10), (1000, 20), (300, 12), (1000, 45)):
        for _ in range(6):
            first = [f"w{int(20000 ** rng.random())}" for _ in range(words)]
            out += [" ".join(first), edited(rng, first, replaced)]
    return out


def test_one_of_each_group_of_similar_texts(spark, table):  # noqa: F811
    texts = [*texts_with_near_copies(random.Random(4)), *ODD, "a b c d", "A b  c d", "a b c e"]
    docs = table(texts, clash=("fp", "mark", "n", "buckets"))
    roots = classes([plain_shingles(t) for t in texts], similar)
    kept = found(corpus_pipeline.near_dedup(spark, docs, ""))
    assert [r["doc_id"] for r in kept] == sorted(set(roots)) and set(kept[0]) == set(docs.columns)


def test_a_large_group_is_one_component(table):  # noqa: F811
    rng = random.Random(7)
    first = [f"w{int(20000 ** rng.random())}" for _ in range(200)]
    docs = table([edited(rng, first, 2) for _ in range(300)])
    assert near_copies.one_of_each(docs).count() == 1
    shared = near_copies.buckets_of(near_copies.signatures(docs))
    assert near_copies.candidates(shared, 0.8).count() <= near_copies.NEIGHBOURS * near_copies.BANDS * 300


def test_links_beyond_the_neighbours_of_a_bucket(table, monkeypatch):  # noqa: F811
    """Everything shares one bucket: components are then those of all pairs, however the sets are ordered in it."""
    rng = random.Random(12)
    monkeypatch.setattr(near_copies, "signature", lambda found: near_copies.np.array([1, 2], "u8"))
    families = [[f"w{int(20000 ** rng.random())}" for _ in range(200)] for _ in range(12)]
    texts = [edited(rng, rng.choice(families), rng.randrange(7)) for _ in range(90)]
    texts += [" ".join(families[0] + families[1]), *ODD[3:]]
    roots = classes([plain_shingles(t) for t in texts], similar)
    assert 12 < len(set(roots)) < 60
    assert [r["doc_id"] for r in found(near_copies.one_of_each(table(texts)))] == sorted(set(roots))
    monkeypatch.setattr(near_copies, "NEIGHBOURS", 1)
    assert [r["doc_id"] for r in found(near_copies.one_of_each(table(texts)))] == sorted(set(roots))


def test_every_link_of_a_family_by_similarity(table):  # noqa: F811
    """Groups of 2, 10 and 300 near copies around three similarities: the share of rows in the right component."""
    rng = random.Random(13)
    texts, where = [], []
    for replaced in (3, 5, 6):
        for size in (2, 10, 100):
            where.append(len(texts))
            for _ in range(100 // size):
                first = [f"w{int(20000 ** rng.random())}" for _ in range(300)]
                texts += [" ".join(first), *(edited(rng, first, replaced) for _ in range(size - 1))]
    kept = [r["doc_id"] for r in found(near_copies.one_of_each(table(texts)))]
    want = sorted(set(classes([plain_shingles(t) for t in texts], similar)))
    for low, high in zip(where, [*where[1:], len(texts)]):
        mine, true = (sum(low <= i < high for i in ids) for ids in (kept, want))
        assert true <= mine <= true + 0.1 * (high - low - true), (low, high)


def test_repeated_rows_null_ids_and_no_rows(table):  # noqa: F811
    text = " ".join(f"w{i}" for i in range(50))
    rows = found(near_copies.one_of_each(table([(None, text), (4, text), (3, text + " end"), (3, text + " end"), (9, "x")])))
    assert [r["doc_id"] for r in rows] == [3, 9]
    assert near_copies.one_of_each(table([])).count() == 0


def test_the_links_of_the_simhash_operator_take_part(spark, table):  # noqa: F811
    """Where no two sets are similar enough, the components are those of operator 2."""
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        first = [f"w{int(20000 ** rng.random())}" for _ in range(1500)]
        texts += [" ".join(first), edited(rng, first, 1), edited(rng, first, 40)]
    docs = table([*texts, *ODD, None, "One", (None), " "])
    want = [r["doc_id"] for r in found(simhash.one_of_each(docs))]
    assert 24 < len(want) < docs.count() - 12
    assert [r["doc_id"] for r in found(near_copies.one_of_each(docs, similarity=2.0, fingerprints=True))] == want
    assert len(found(corpus_pipeline.near_dedup(spark, docs, ""))) <= len(want)


def test_pairs_that_unique_shingles_rule_out_are_not_made(table, monkeypatch):  # noqa: F811
    """A family in one bucket: results of all pairs, with far fewer of them than outsiders times sets."""
    rng = random.Random(5)
    monkeypatch.setattr(near_copies, "signature", lambda found: near_copies.np.array([1], "u8"))
    first = [f"w{int(20000 ** rng.random())}" for _ in range(200)]
    texts = [edited(rng, first, 1 if i % 2 else 5 + i % 40) for i in range(160)]
    docs = table(texts)
    roots = classes([plain_shingles(t) for t in texts], similar)
    made, real = [], near_copies.links
    monkeypatch.setattr(near_copies, "links", lambda pairs, *a: made.append(pairs.count()) or real(pairs, *a))
    assert [r["doc_id"] for r in found(near_copies.one_of_each(docs))] == sorted(set(roots))
    assert len(set(roots)) > 60 and sum(made) <= 4 * 160
    made.clear()
    monkeypatch.setattr(near_copies, "LARGE", 1000)
    assert [r["doc_id"] for r in found(near_copies.one_of_each(docs))] == sorted(set(roots))
    assert sum(made) > 20 * 160


def test_pairs_that_sketches_rule_out_are_not_made(table, monkeypatch):  # noqa: F811
    """A family whose edits come from few words, so that shingles are shared but sets are not alike: one bucket, few pairs."""
    rng = random.Random(8)
    monkeypatch.setattr(near_copies, "signature", lambda found: near_copies.np.array([1], "u8"))
    first = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(240):
        words = list(first)
        for at in rng.sample(range(60), 1 if i % 8 == 0 else 3):
            words[at] = f"v{rng.randrange(3)}"
        texts.append(" ".join(words))
    docs = table(texts)
    roots = classes([plain_shingles(t) for t in texts], similar)
    made, real = [], near_copies.links
    monkeypatch.setattr(near_copies, "links", lambda pairs, *a: made.append(pairs.count()) or real(pairs, *a))
    assert [r["doc_id"] for r in found(near_copies.one_of_each(docs))] == sorted(set(roots))
    assert len(set(roots)) > 60 and sum(made) <= 8 * 240


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = near_copies.np.random.default_rng(2)
    for size in (0, 1, 40, 3000):
        both = rng.integers(0, 2**63, size * 2, dtype=near_copies.np.uint64)
        one, two = both[: size + size // 2], both[size // 2 :]
        apart = near_copies.np.bitwise_count(near_copies.sketch(one) ^ near_copies.sketch(two)).sum()
        assert apart <= len(set(one.tolist()) ^ set(two.tolist()))
        assert size < 3000 or apart > 100


def test_rows_that_spread_are_not_broadcast(spark):
    """Sets by bucket, and outsiders dealt into parts, are many times the rows by which Spark sizes them."""
    sets = spark.range(40).selectExpr("concat('f', id) as fp", "id + 5 as n", "array(id % 3, id % 7) as buckets")
    shared = near_copies.buckets_of(near_copies.written(sets, "signatures"))
    assert shared.count() == 80
    bits = [f"id as {name}" for name in near_copies.SKETCH]
    members = spark.range(40).selectExpr("id % 3 as bucket", "concat('f', id) as fp", "20L as n", "null + 0L as c", "concat('f', id) as root", "'f1' as main", *bits)
    tried = near_copies.written(spark.createDataFrame([("f4", "f1")], "a string, b string"), "pairs")
    rest = near_copies.outsiders(near_copies.written(members, "members"), tried, 0.8)
    assert rest.count() == 14 * 13 // 2 + 2 * 13 * 12 // 2 - 1
    for rows in (shared, rest):
        plan = rows._jdf.queryExecution().executedPlan().toString().splitlines()
        assert any("SortMergeJoin" in line and "Inner" in line for line in plan) and not any("BroadcastHashJoin" in line and "Inner" in line for line in plan)
