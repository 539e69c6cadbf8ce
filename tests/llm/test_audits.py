"""Operators 11 to 13: source divergence, url filters, periodic runs, against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import DOCS as ODD
from llm_data import found, table  # noqa: F401
from pyspark.sql import functions as F

from parley.llm import divergence, periodic, queries, urls

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Operator 11


def plain_audit(rows, least, top=50):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(words)
        df[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def shares(count):
            below = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // below for t in kept}

        of = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(of[s][t] - of[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(q[t] - of[s][t], t) for t in kept if counts[lang, s][t] and of[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items = sorted(items, key=lambda x: (x[0], x[1].encode()))[: top if part == "term" else None]
                out |= {(lang, s, part, item, -value, k + 1) for k, (value, item) in enumerate(items)}
    return out


def documents_of(spark, rows):
    made = spark.createDataFrame(rows, "text string, lang string, source string")
    return made.withColumn("doc_id", F.lit(1)).withColumn("term", F.lit("x")).withColumn("value", F.lit(2)).withColumn("n", F.lit(3))


@pytest.mark.parametrize("block, held", [(32_768, 300_000), (5, 20)])
def test_divergence_against_plain_python(spark, monkeypatch, block, held):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(3)
    vocabulary = ["Straße", "été", "don't", "x1y", "A-b", "ΣΑΣ", "ÉTÉ", "日本", *"abcdefghij"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["s", "t", "u", None])) for _ in range(90)]
    rows += [(t, "odd", "only") for t in ODD] + [(None, "none", "a"), ("", "none", "b"), ("once", "none", None), ("a b", "en", "é"), ("12 3", "en", "empty")]
    rows += rows[:20]
    got = divergence.audit(documents_of(spark, rows), least=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = plain_audit(rows, 4)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert {r[4] for r in want if r[0] == "none"} == {0}


def test_divergence_with_a_hot_source_and_a_top_that_cuts(spark):
    rng = random.Random(4)
    rows = [(" ".join(f"w{chr(97 + int(rng.paretovariate(1)) % 26)}{chr(97 + rng.randrange(26))}" for _ in range(60)), "en", f"s{max(0, k % 9 - 5)}") for k in range(300)]
    got = divergence.audit(documents_of(spark, rows), least=30, top=3)
    assert {tuple(r) for r in got.collect()} == plain_audit(rows, 30, 3)


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(documents_of(spark, [])).collect() == []


@given(st.lists(st.integers(0, 60), unique=True), st.lists(st.integers(0, 60), unique=True))
@settings(max_examples=300, deadline=None)
def test_galloping_finds_what_bisection_finds(few, many):
    few, many = np.array(sorted(few), np.int64), np.array(sorted(many), np.int64)
    assert divergence.gallop(few, many).tolist() == np.searchsorted(many, few).tolist()


@given(st.lists(st.integers(0, 10**16), min_size=1), st.integers(0, 10**6))
@settings(max_examples=300, deadline=None)
def test_shares_are_exact(counts, more):
    below = sum(counts) + 5 * len(counts) + more
    assert divergence.shares(np.array(counts, np.int64), below).tolist() == [1 + 10**9 * (c + 5) // below for c in counts]


# Operator 12

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "Example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"), ("allow", "a.b"), ("block", "a.b"), (None, None), ("allow", "b/x"), ("block", "a.b/")]
URLS = [
    None, "", "no scheme", "://", "x://", "http://Example.ORG/es/1", "http://www.example.org/es", "https://example.org/en/12?a#b", "http://notexample.org/es/",
    "http://org", "http://org/", "http://a.com/fr/x", "http://a.com/de/x", "http://com/de/", "http://a.com/DE/x", "http://u:p@a.com:80/fr/", "http://x.a.b?c/d",
    "http://x.a.b/x/y", "http://ab/x", "http://q.ab.b/x", "http://org./x", "http://..org/x", "http://é.org/é😀#x", "http://a\nb.org/x\ny", "http://" + "s." * 3000 + "org/" + "p/" * 5000,
    "http://example.org/es/://example.com/fr/", "ftp://example.com/fr/?x",
]


def plain_verdict(url, rules, default="allow"):
    rest = (url or "").partition("://")[2]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    best = None
    for verdict, rule in rules:
        if rule is None:
            continue
        own = rule.partition("/")[0].translate(LOWER)
        start = rule[len(own) :]
        if (host == own or host.endswith("." + own)) and path.startswith(start):
            best = max(best or (-1,), (len(rule), len(own), verdict, own + start))
    return host, path, best and best[3], best[2] if best else default


def judged(spark, texts, rules):
    pages = spark.createDataFrame([(i % 7, u) for i, u in enumerate(texts)], "page_id long, url string")
    for name in ("host", "path", "rule", "verdict", "digest", "part", "salt"):
        pages = pages.withColumn(name, F.lit("clash"))
    return urls.judge(pages, spark.createDataFrame(rules, "verdict string, rule string"))


def test_urls_against_plain_python(spark):
    texts = URLS * 3
    got = judged(spark, texts, RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert Counter(map(tuple, got.collect())) == Counter((i % 7, *plain_verdict(u, RULES)) for i, u in enumerate(texts))


def test_many_rules_that_share_a_hash_prefix(spark, monkeypatch):
    monkeypatch.setattr(urls, "PREFIX", 1)
    rng = random.Random(8)
    name = lambda: ".".join(rng.choices("abc", k=rng.randrange(1, 4)))
    path = lambda: "/" + "".join(rng.choices("xy/", k=rng.randrange(4)))
    rules = [(rng.choice(["allow", "block"]), name() + path()) for _ in range(120)]
    texts = [f"http://{name()}{path()}" for _ in range(400)] + ["http://a.b/x"] * 300
    got = judged(spark, texts, rules)
    assert Counter(map(tuple, got.collect())) == Counter((i % 7, *plain_verdict(u, rules)) for i, u in enumerate(texts))


def test_urls_of_empty_tables(spark):
    assert judged(spark, [], RULES).collect() == []
    assert [r.verdict for r in judged(spark, ["http://a.org/"], []).collect()] == ["allow"]


def test_urls_run_without_python_on_workers(spark):
    plan = queries.QUERIES["op12_urls"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Operator 13


def plain_runs(words, least=6, times=4):
    """Every period by itself; a stretch keeps its smallest."""
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in out.items())


def plain_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plain_planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def periodic_texts(rng):
    out = []
    for _ in range(150):
        words = [rng.choice("ab" if rng.random() < 0.5 else "abcd") for _ in range(rng.randrange(80))]
        if words and rng.random() < 0.7:
            a, p = rng.randrange(len(words)), rng.randrange(1, 12)
            words = words[:a] + [words[min(a + (i - a) % p, len(words) - 1)] for i in range(a, len(words) + 20)]
        out.append(" ".join(words))
    return out


def test_runs_against_plain_python(table):  # noqa: F811
    texts = [*ODD, *periodic_texts(random.Random(6)), "x y " * 5, "x " * 6, "x " * 5, "x y z " * 4, "x y z " * 3 + "x y"]
    rows = found(periodic.runs(table(texts, clash=("runs", "n_words", "collapsed", "start"))))
    for text, r in zip(texts, rows):
        words = words_of(text)
        want = plain_runs(words)
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == want, text
        assert (r["n_words"], bytes(r["collapsed"]).decode()) == (len(words), plain_collapsed(words, want))


@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), max_size=5), st.integers(2, 6), st.integers(1, 9))
@settings(max_examples=400, deadline=None)
def test_runs_of_any_words(lists, times, least):
    of, *parts = periodic.find(lists, least, times)
    got = [[] for _ in lists]
    for k, *run in zip(of.tolist(), *(p.tolist() for p in parts)):
        got[k].append(tuple(run))
    assert got == [plain_runs(words, least, times) for words in lists]


def test_runs_in_long_texts(table):  # noqa: F811
    rng = random.Random(9)
    passage = " ".join(str(rng.randrange(10**6)) for _ in range(30))
    texts = ["same " * 400_000, "a b c d e " * 100_000, " ".join(f"{passage} {i}" for i in range(4000)), "one " * 7 + "x" * 2_000_000]
    rows = found(periodic.runs(table(texts)))
    assert [[tuple(x.values()) for x in r["runs"]] for r in rows] == [[(0, 400_000, 1)], [(0, 500_000, 5)], [], [(0, 7, 1)]]


def test_op13_against_plain_python(spark, tmp_path):
    texts = periodic_texts(random.Random(7))
    rows = [(i, t) for i, t in enumerate([*texts, *ODD])] + [(None, "x " * 9), (None, None), (3, texts[3]), (3, texts[3])]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_periodic"](spark, str(tmp_path))
    want = []
    for key, text in rows:
        words = plain_planted(key, words_of(text))
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        digests = [sha256(x.encode()).hexdigest() for x in (lines, plain_collapsed(words, runs))]
        want.append((key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digests))
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_op13_over_the_small_tables(spark):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in queries.QUERIES["op13_periodic"](spark, SMALL).collect()}
    assert len(got) == len(texts)
    for key, text in texts:
        words = plain_planted(key, words_of(text))
        if len(words) <= 3000:  # the plain version compares every period
            runs = plain_runs(words)
            assert got[key].n_runs == len(runs)
            assert got[key].collapsed_sha256 == sha256(plain_collapsed(words, runs).encode()).hexdigest()


def test_runs_of_an_empty_table(table):  # noqa: F811
    assert found(periodic.runs(table([]))) == []
