"""Operators 5 and 8, the registered queries and the pipeline."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import DOCS as ODD
from llm_data import found, table  # noqa: F401
from pyspark.sql import functions as F
from test_copies import classes, copies, plain_fingerprint
from test_filters import plain_hits
from test_near_copies import plain_shingles, similar
from tokenizers import Tokenizer

import corpus_pipeline
from parley.llm import pii, quality, sharding, simhash, toxicity
from parley.llm.queries import ORACLE, QUERIES, VOCABULARY

SMALL = "/root/testdata/sf0.001"


def sizes_of(rows, shards):
    out = [0] * shards
    for r in rows:
        out[r["shard"]] += r["size"]
    return out


def check_slots(rows):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_hold_every_row_and_near_equal_bytes(table):  # noqa: F811
    rng = random.Random(6)
    texts = [*ODD, *("x" * rng.randrange(20, 3000) + str(i % 700) for i in range(900))]
    rows = found(sharding.shard(table(texts, clash=("unit", "piece", "shard", "size")), 5))
    assert [(r["size"], r["text_crc32"]) for r in rows] == [
        (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts
    ]
    sizes = sizes_of(rows, 5)
    assert max(sizes) - min(sizes) < 0.01 * sum(sizes) / 5 and {r["law"] for r in rows} == {"bytes"}
    check_slots(rows)
    assert all(r["grown_shard"] is None for r in rows)


def test_equal_texts_stay_together_unless_they_would_fill_a_shard(table):  # noqa: F811
    rng = random.Random(1)
    texts = [f"text {rng.randrange(60)} " * 20 for _ in range(600)] + ["hot " * 100] * 400
    rows = found(sharding.shard(table(texts), 4))
    homes = {}
    for t, r in zip(texts, rows):
        homes.setdefault(t, set()).add(r["shard"])
    assert len(homes.pop("hot " * 100)) > 1 and all(len(h) == 1 for h in homes.values())
    sizes = sizes_of(rows, 4)
    assert max(sizes) < 1.05 * sum(sizes) / 4
    check_slots(rows)


def test_shards_of_repeated_rows_null_ids_and_nothing(table):  # noqa: F811
    rows = found(sharding.shard(table([(1, "a"), (1, "a"), (None, None), (None, None)]), 3))
    assert len(rows) == 4
    check_slots(rows)
    assert sharding.shard(table([]), 3).count() == 0


def test_packing_takes_the_highest_dot_product():
    sizes = np.array([[5.0, 1, 1], [4, 1, 1], [3, 1, 1], [2, 1, 1], [1, 1, 1], [1, 1, 1]])
    got = sharding.pack(sizes, np.tile(sizes.sum(axis=0) / 2, (2, 1)))
    assert sorted(np.bincount(got, sizes[:, 0]).tolist()) == [8.0, 8.0]


def plain_packing(sizes, capacity):
    """The rule in plain Python: larger groups first, each to the shard of the highest dot product with what is left."""
    whole = [sum(c[k] for c in capacity) for k in range(3)]
    left = [[c[k] / whole[k] for k in range(3)] for c in capacity]
    out = [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i][0], i)):
        v = [sizes[i][k] / whole[k] for k in range(3)]
        scores = [sum(w * x * y for w, x, y in zip(sharding.WEIGHTS, v, room)) for room in left]
        out[i] = max(range(len(left)), key=lambda s: (scores[s], -s))
        left[out[i]] = [a - b for a, b in zip(left[out[i]], v)]
    return out


def test_packing_equals_plain_packing():
    rng = random.Random(8)
    sizes = [[rng.randrange(20, 5000), rng.randrange(1, 900), rng.randrange(1, 4)] for _ in range(500)]
    capacity = [[sum(s[k] for s in sizes) / 7 for k in range(3)]] * 7
    assert sharding.pack(np.array(sizes, float), np.array(capacity)).tolist() == plain_packing(sizes, capacity)


def test_bytes_tokens_and_rows_are_balanced_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sums = sharding.shard(docs, 40).groupBy("shard").agg(F.sum("size"), F.sum("tokens"), F.count("*")).collect()
    totals = np.array([r[1:] for r in sums], float)
    spread = (totals.max(axis=0) - totals.min(axis=0)) / totals.mean(axis=0)
    assert len(sums) == 40 and (spread < [0.01, 0.01, 0.05]).all(), spread  # a row is 0.004 of a shard


# --- toxicity ------------------------------------------------------------------------------------------


def model():
    counts = np.zeros((28, 28, 28))
    for word in "you are a such an total awful loser idiot stupid clown moron trash here the cat and dog of all that is worthless pathetic".split() * 20:
        s = [0, 0, *map(toxicity.symbol, word), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            counts[a, b, c] += 1
    return toxicity.language_model(counts)


@pytest.mark.parametrize(
    "text,words",
    [
        ("you are a l0ser", ["you", "are", "a", "loser"]),
        ("i d i o t here", ["idiot", "here"]),
        ("such a stuuuupid m.o.r.o.n!", ["such", "a", "stupid", "moron"]),
        ("$tupid tr@sh", ["stupid", "trash"]),
        ("cl*wn", ["clown"]),
        ("the cat, and (dog)", ["the", "cat", "and", "dog"]),
        ("12 345 !!! ---", []),
        (None, []),
    ],
)
def test_disguised_words_are_restored(text, words):
    own = toxicity.Restorer(model())
    got = own.words(text.encode() if text else None)
    assert [w for w in got if w.isalpha()] == words


def model_of(words):
    counts = np.zeros((28, 28, 28))
    for word in words:
        s = [0, 0, *map(toxicity.symbol, word), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            counts[a, b, c] += 1
    return toxicity.language_model(counts)


@pytest.mark.parametrize(
    "text,words",
    [
        ("dumba$$ $$hit", ["dumbass", "shit"]),  # letters at edges
        ("(unt |diot", ["cunt", "idiot"]),
        ("@$$ 455", ["ass", "ass"]),  # no letter at all
        ("dog$$$ (dog) cat!! that*** the### <cat>", ["dog", "dog", "cat", "that", "the", "cat"]),  # plain words with noise beside them
        ("$$$ | ### !!!", []),
        ("2014 $100 (985)", ["2014", "100", "985"]),
    ],
)
def test_signs_at_edges_and_words_of_signs_have_both_readings(text, words):
    common = "dumbass ass shit cunt idiot".split() * 40 + "dog cat that the".split() * 30
    assert toxicity.Restorer(model_of(common)).words(text.encode()) == words


@pytest.mark.parametrize("signs,beside", [("$$", "ba"), ("$", "b"), ("(<", "a"), ("@", ""), ("|!", "at")])
def test_an_edge_reads_as_in_the_whole_word(signs, beside):
    own = toxicity.Restorer(model_of("dumbass ass shit cunt idiot bat at the cat of bars".split() * 20))
    for rest in ("r", "os", "cr"):  # no doubled letters, which the whole lattice may fold
        whole = own.decoder.read(signs + beside + rest, range(len(signs), 99))
        assert whole == [own.edge(signs, (beside + rest)[:2], True) + beside + rest]
        text = rest + beside + signs
        assert own.decoder.read(text, range(len(text) - len(signs))) == [rest + beside + own.edge(signs, (rest + beside)[-2:], False)]


def test_weights_through_roots_equal_weights_of_all_features():
    weights = {toxicity.features(w)[k]: x for w, k, x in (("moron", 0, 3.0), ("moronic", 1, 1.5), ("moro", 0, -1.0), ("at", 0, 2.0))}
    roots = {toxicity.features(toxicity.root_of(w).rstrip("$"))[0 if len(w) < 4 else 1] for w in ("moron", "at")}
    own = toxicity.Figures(model(), weights, roots)
    for word in ("moron", "moronic", "moronical", "moro", "mor", "at", "atom", "", "é"):
        known = [weights[f] for f in toxicity.features(word) if f in weights]
        assert own.weight(word) == (0.0 if not known or known[0] <= 0 else max(known))


@settings(max_examples=150, deadline=None)
@given(st.text("ab1$* .-ZÉ\n", max_size=30))
def test_any_text_is_read(text):
    toxicity.Restorer(model()).words(text.encode())


def test_the_model_counts_all_documents(table):  # noqa: F811
    counts = toxicity.trigram_counts(table(["ab ab", "AB, x9", None, "", "é"]))
    want = np.zeros((28, 28, 28))
    for word, n in (("ab", 3), ("é", 1)):
        s = [0, 0, *map(toxicity.symbol, word), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            want[a, b, c] += n
    assert (counts == want).all()


def labelled(rng, n):
    plain = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "re") for b in ("ton", "vel", "dan") for c in ("s", "a", "um")]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(20, 80))
        bad = i % 4 == 0
        for _ in range(rng.randrange(1, 4) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["scumbag", "moronic", "sc*mbag", "m0r0nic", "s c u m b a g", "moroniiiic"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_documents_are_told_apart(spark, table):  # noqa: F811
    docs, labels = labelled(random.Random(3), 800)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    extra = [(9000 + i, t) for i, t in enumerate(ODD)] + [(None, "moronic")]
    rows = found(toxicity.score(table(docs + extra, clash=("toxic", "x1")), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"), ~held_out))
    assert len(rows) == len(docs) + len(extra) and all(0 <= r["score"] <= 1 for r in rows)
    truth = dict(labels)
    test = [(truth[r["doc_id"]], r["score"]) for r in rows if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = sum((s >= 0.5) == bool(y) for y, s in test)
    assert right >= 0.97 * len(test) > 100


@pytest.mark.parametrize("labels", [[], [(0, 0), (1, 0)], [(0, 1)]])
def test_labels_of_one_kind_or_none(spark, table, labels):  # noqa: F811
    rows = found(toxicity.score(table(["a b", "c d"]), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True)))
    assert {round(r["score"]) for r in rows} == {1 if labels == [(0, 1)] else 0}
    assert toxicity.score(table([]), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True)).count() == 0


# --- queries and pipeline ------------------------------------------------------------------------------


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in QUERIES and set(ORACLE) <= set(QUERIES)


PER_DOCUMENT = sorted(n for n in QUERIES if n not in ("pipeline", "op11_divergence", "op12_urls"))


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_queries_return_a_row_per_document(spark, name):
    want = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()
    got = QUERIES[name](spark, SMALL).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in want)


def plain_pipeline(texts, items):
    """The whole pipeline over (id, text) rows in plain Python."""
    import zstandard

    press = zstandard.ZstdCompressor(level=quality.LEVEL)
    rows = [(i, t) for i, t in texts if quality.measure(t.encode() if t else None, press)[-1]]
    roots = classes([plain_shingles(t) for _, t in rows], similar)
    first = {}
    for (i, t), r in zip(rows, roots):
        first[r] = min(first.get(r, (i, t)), (i, t))
    rows = sorted(first.values())
    rows = [r for r, (n, hit, _) in zip(rows, plain_hits([t for _, t in rows], items)) if not (hit and 20 * hit >= n)]
    library = Tokenizer.from_file(VOCABULARY)
    out = {}
    for i, t in rows:
        ids = library.encode(pii.masked(t), add_special_tokens=False).ids
        out[i] = (ids, library.decode(ids, skip_special_tokens=False))
    return out


def write(spark, folder, texts, items):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_against_plain_python(spark, tmp_path):
    rng = random.Random(11)
    texts = [(i, t) for i, t in enumerate([*ODD, *copies(rng, 30), *(f"mail a{i}@b.cc " + " ".join(map(str, rng.choices(range(999), k=60))) for i in range(5))])]
    items = [(0, " ".join(texts[-8][1].split()[:40])), (1, " ".join(texts[-1][1].split()[3:30]))]
    write(spark, tmp_path, texts, items)
    got = {r.doc_id: (np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = plain_pipeline(texts, items)
    assert got == want and 0 < len(want) < len(texts)


def test_pipeline_over_the_small_tables(spark):
    d = duckdb.connect()
    texts = d.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    items = d.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    got = {r.doc_id: (np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == plain_pipeline(texts, items)


def test_stages_keep_the_columns_and_all_that_they_do_not_reject(spark, tmp_path):
    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "benchmark", "personal", "bpe"]
    clean = [(i, " ".join(f"word{random.Random(i * 100 + k).randrange(10**6)}" for k in range(60))) for i in range(10)]
    write(spark, tmp_path, clean, [(0, "something that is in none of the documents at all")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 10, name


def test_pipeline_of_nothing(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_simhash_classes_of_the_small_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    ids = [r.doc_id for r in docs.orderBy("doc_id").collect()]
    want = classes([plain_fingerprint(t) for t in texts], lambda a, b: (a ^ b).bit_count() <= 2)
    assert [r["component_id"] for r in found(simhash.groups(docs))] == [ids[w] for w in want]
