"""Operators 4 and 10: the token files and the BPE codec, against the tokenizers library."""

import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import DOCS as ODD
from llm_data import found, table  # noqa: F401
from tokenizers import Tokenizer

from parley.llm import bpe, simple8b, token_files
from parley.llm.common import in_arrow, pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def unpacked(ids):
    return np.frombuffer(bytes(ids), "<u4").tolist()


def texts(seed, n=300):
    rng = random.Random(seed)
    letters = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x370), *range(0x391, 0x3CA), 0x1E9E, 0x2028, 0x3000, 0x4E00, 0xAC00, 0x1F600]]
    letters += ["'s", "'LL", " ", "\n", "aaaa", "<|endoftext|>", "ing", "tion", "the "]
    return ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(n)]


def test_ids_and_text_are_those_of_the_library(library, table):  # noqa: F811
    rows = [*ODD, *texts(1)]
    got = found(bpe.encode_and_decode(table(rows, clash=("ids", "decoded")), PATH))
    for text, row in zip(rows, got):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert unpacked(row["ids"]) == ids, text
        assert row["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_encode_then_decode_apart(library, table):  # noqa: F811
    docs = table([(None, "Hello World"), (1, None), (1, "twice"), (1, "twice")])
    encoded = bpe.encode(docs, PATH)
    got = found(bpe.decode(encoded, PATH))
    assert [(r["doc_id"], r["text"]) for r in got] == [(None, "hello</w> world</w>"), (1, ""), (1, "twice</w>"), (1, "twice</w>")]
    assert bpe.encode(table([]), PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text("a \n\té", max_size=60), st.integers(1, 20))
def test_pieces_end_between_words(text, most):
    data = text.encode()
    parts = list(pieces(data, most))
    assert b"".join(parts) == data and [w for p in parts for w in p.split()] == data.split()


def test_a_small_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr("parley.llm.common.CACHE_WORDS", 50)
    own = bpe.Codec(PATH)
    rows = texts(5, 60)
    for part in (rows, rows[::-1]):
        for text in part:
            assert unpacked(own.encode_all([text.encode()])[0]) == library.encode(text, add_special_tokens=False).ids


def test_the_caches_hold_words_that_are_met_again(library, monkeypatch):
    own, rng = bpe.Codec(PATH), random.Random(4)
    once = [" ".join("".join(rng.choices("abcdefgh", k=12)) for _ in range(200)) for _ in range(20)]
    for text in once:
        assert unpacked(own.encode_all([f"{text} often,".encode()])[0]) == library.encode(f"{text} often,", add_special_tokens=False).ids
    assert b"often," in own.chunks and max(len(own.chunks), len(own.words)) < 200  # of 4,000 words met once
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    monkeypatch.setattr(bpe, "MET_PLACES", 8)
    own = bpe.Codec(PATH)
    for text in texts(5) * 2:
        assert unpacked(own.encode_all([text.encode()])[0]) == library.encode(text, add_special_tokens=False).ids, text


def test_short_words_of_a_pass_are_merged_together(library, monkeypatch):
    own, rng = bpe.Codec(PATH), random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnopé", k=rng.randrange(1, 30))) for _ in range(3000)]
    steps, pops, entries = [], [], own.entries
    monkeypatch.setattr(own, "entries", lambda *a: steps.append(1) or entries(*a), raising=False)
    pop = bpe.heapq.heappop
    monkeypatch.setattr(bpe.heapq, "heappop", lambda *a: pops.append(1) or pop(*a))
    ids = own.encode_all([w.encode() for w in words])
    assert not pops and len(steps) < 2 * 64  # one by one these words take tens of thousands
    monkeypatch.undo()
    assert [unpacked(x) for x in ids] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    long = ["a" * 70, "ab" * 50, "x" * 63 + "é", "x" * 64 + "é", "abc" * 400]
    assert [unpacked(x) for x in own.encode_all([w.encode() for w in long])] == [
        e.ids for e in library.encode_batch(long, add_special_tokens=False)
    ]


def test_each_kind_of_run_is_split_as_the_library_does(library):
    own = bpe.Codec(PATH)
    heads = ["Word", "word", "ÉTÉ", "été", "a\u0301", "J\u030c", "ΣΑΣ", "ß", "\u1e9e", "word's", "x2", "\u4e00", "\u02b0a", "<|x", "w<|endoftext|>w", "\u00a0"]
    rows = [h + t for h in heads for t in ["", ",", "...", "!?", "'", "'s", ",'s", "_", "<|", "<|endoftext|>", "§", "\u0301", "9."]]
    for row in [*rows, " ".join(rows)]:
        assert unpacked(own.encode_all([row.encode()])[0]) == library.encode(row, add_special_tokens=False).ids, row


@pytest.mark.parametrize("seed", range(6))
def test_symbols_that_several_pairs_make(tmp_path, seed):
    """There a pair of a lower rank may arise before all positions of a rank are merged."""
    rng = random.Random(seed)
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    letters = bpe.byte_letters()
    vocab = {t: i for i, t in enumerate([*letters, *(x + "</w>" for x in letters)])}
    inner, last, merges = ["a", "b", "c"], ["a</w>", "b</w>", "c</w>"], []
    while len(merges) < 60:
        left, right = rng.choice(inner), rng.choice(inner + last)
        if [left, right] not in merges and len(left + right) < 12:
            merges.append([left, right])
            if left + right not in vocab:
                vocab[left + right] = len(vocab)
                (last if right.endswith("</w>") else inner).append(left + right)
    rng.shuffle(merges)
    spec["model"] |= {"vocab": vocab, "merges": merges}
    spec["added_tokens"] = [t | {"id": len(vocab) + k} for k, t in enumerate(spec["added_tokens"])]
    if isinstance(spec.get("post_processor"), dict):
        spec["post_processor"] = None
    path = str(tmp_path / "made_up.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    library, own = Tokenizer.from_file(path), bpe.Codec(path)
    assert not own.at_once.all()
    words = ["".join(rng.choices("abc"[: rng.randrange(1, 4)], k=rng.randrange(1, 90))) for _ in range(600)]
    ids = own.encode_all([" ".join(words).encode()])[0]
    assert unpacked(ids) == library.encode(" ".join(words), add_special_tokens=False).ids


def test_workers_get_batches_of_a_few_megabytes(spark):
    docs = spark.range(4000, numPartitions=1).selectExpr("id AS doc_id", "repeat(chr(97 + id % 26), 4000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    got = in_arrow(docs, sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 4000 and max(r["size"] for r in got) < 3 << 20


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, (1 << 60) - 1) | st.integers(0, 70_000) | st.integers(0, 1), max_size=400))
def test_simple8b_round_trip(values):
    words = simple8b.pack(np.array(values, np.uint64))
    assert simple8b.unpack(words, len(values)).tolist() == values
    before = simple8b.offsets(words)
    assert len(before) == len(words) and (not values or before[-1] < len(values))


def test_simple8b_is_dense_and_refuses_wide_values():
    assert len(simple8b.pack(np.ones(60, np.uint64))) == 1
    assert len(simple8b.pack(np.full(30, 40_000, np.uint64))) == 10
    with pytest.raises(ValueError):
        simple8b.pack(np.array([1 << 60], np.uint64))


@pytest.mark.parametrize("block", [1, 1 << 16])
def test_files_hold_every_document_in_order(spark, library, table, tmp_path, block):  # noqa: F811
    rows = [(i * 7 % 311, t) for i, t in enumerate([*ODD, *texts(2)])] + [(None, "no id"), (3, "again"), (3, "again")]
    folder = str(tmp_path / "tokens")
    token_files.write(table(rows, clash=("tie", "part")), PATH, 2, folder, block)
    got = token_files.read(spark, folder).join(token_files.block_starts(spark, folder), ["part", "block"]).collect()
    got = sorted(got, key=lambda r: r.block_start + r.before)
    assert [r.doc_id is not None and r.doc_id for r in got] == sorted((d is not None and d for d, _ in rows))
    at = 0
    for r in got:
        assert r.block_start + r.before == at
        at += len(r.ids) // 4
    want = sorted((d or 0, library.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows)
    assert sorted((r.doc_id or 0, unpacked(r.ids)) for r in got) == want


def test_no_documents_no_ids(spark, table, tmp_path):  # noqa: F811
    folder = str(tmp_path / "tokens")
    token_files.write(table([]), PATH, 2, folder)
    assert token_files.read(spark, folder).count() == token_files.block_starts(spark, folder).count() == 0


def test_places_reached_by_steps():
    rng = np.random.default_rng(6)
    for n in (1, 2, 17, 1000):
        for most in (2, 4, 61):
            step, want, at = rng.integers(1, most, n), [], 0
            while at < n:
                want.append(at)
                at += int(step[at])
            for doublings in (0, 1, 4):
                assert simple8b._reached(step, doublings).tolist() == want
