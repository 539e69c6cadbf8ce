"""Benchmark decontamination by winnowing.

Of the hashes of all ``GRAM``-word grams the smallest in each run of ``WIDTH - GRAM + 1`` grams is kept as a fingerprint, on both
sides, so any ``WIDTH``-word span that a document shares with an item holds a fingerprint of both. The fingerprints of the
benchmark go out as a bitmap of a fixed size, ``BITS``. A document's fingerprint that is in it is extended to the windows
around it; those meet the windows of the items in a join on a 128-bit digest of their words, which settles false alarms of
the bitmap. Items of fewer words are a window of their own length each; every run of such a length in a document is looked up.

Defined results: null texts have no words and are never contaminated, null items have no windows; an item without an id is
named ``null``; rows are judged each, so repeated ids or rows are returned as often; extra columns are left out by ``hits`` and
kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import Hashes, Rolling, documents, hashes_of, in_arrow, slices, touched, written

WIDTH = 13
GRAM = 8
#: Bits of the filter of fingerprints and windows; its size does not depend on the data.
BITS = 1 << 23
#: A document is contaminated if SHARE times its hit words are as many as its words.
SHARE = 20
_LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_BASE = 0x9E3779B97F4A7C15
#: ``mark`` is the SHA-256 of the text, where there are windows.
CANDIDATES = "doc_id long, n_words long, mark string, windows array<struct<start:int,size:int,digest:binary>>"
_WINDOWS = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("digest", pa.binary())]))


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(_LETTERS).split() if data else []


def digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def fingerprints(grams: np.ndarray, run: int) -> np.ndarray:
    """Places of the smallest hash of each ``run`` consecutive grams, all of them where equal."""
    if len(grams) < run:
        return np.zeros(0, np.int64)
    n = len(grams) - run + 1
    least = grams[:n].copy()
    for d in range(1, run):
        np.minimum(least, grams[d : d + n], out=least)
    chosen = np.zeros(len(grams), bool)
    for d in range(run):
        chosen[d : d + n] |= grams[d : d + n] == least
    return np.flatnonzero(chosen)


def bit_of(hashes: np.ndarray, salt: int) -> np.ndarray:
    """The bit of a hash of a kind: grams have salt 0, windows their size."""
    return ((hashes ^ np.uint64(salt * 0xA24BAED4963EE407 & (1 << 64) - 1)) >> np.uint64(64 - (BITS - 1).bit_length())).astype(np.int64)


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(size, digest, item) of all windows of a benchmark, and (size, bit) of its fingerprints (size 0) and windows."""
    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("item"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, rolling = Hashes(), Rolling(_BASE)
        for batch in batches:
            names = batch.column("item").to_pylist()
            for at, texts in slices(batch):
                for name, data in zip(names[at:], texts):
                    words = words_of(data)
                    if not words:
                        continue
                    size = min(WIDTH, len(words))
                    x = hashes_of(words, cache)
                    bits = bit_of(rolling.windows(x, size), size)
                    digests = [digest(words[i : i + size]) for i in range(len(bits))]
                    marks = np.zeros(0, np.int64)
                    if size == WIDTH:
                        grams = rolling.windows(x, GRAM)
                        marks = bit_of(grams[fingerprints(grams, WIDTH - GRAM + 1)], 0)
                    n, m = len(bits), len(marks)
                    yield pa.record_batch(
                        [
                            pa.array([name] * (n + m)),
                            pa.array([size] * n + [0] * m, pa.int32()),
                            pa.array([*bits.tolist(), *marks.tolist()], pa.int64()),
                            pa.array([*digests, *[None] * m], pa.binary()),
                        ],
                        ["item", "size", "bit", "digest"],
                    )

    found = written(in_arrow(rows, run, "item string, size int, bit long, digest binary").distinct(), "items")
    return found.where("size > 0").select("size", "digest", "item").distinct(), found.select("size", "bit")


def bitmap(bits: DataFrame) -> np.ndarray:
    """The filter as bytes: at most BITS / 32 partial words reach the driver, whatever the size of the benchmark."""
    word = F.shiftright("bit", 5).alias("word")
    part = bits.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("mask")).collect()
    out = np.zeros(BITS // 32, "<u4")
    for row in part:
        out[row["word"]] = row["mask"]
    return out.view(np.uint8)


def candidates(docs: DataFrame, bits: np.ndarray, short: list[int]) -> DataFrame:
    """doc_id, n_words and the windows near a fingerprint that the filter holds, for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, rolling, table = Hashes(), Rolling(_BASE), sent.value

        def held(hashes: np.ndarray, salt: int) -> np.ndarray:
            bit = bit_of(hashes, salt)
            return (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0

        for batch in batches:
            for at, texts in slices(batch):
                split = [words_of(t) for t in texts]
                counts = np.array([len(w) for w in split])
                ends = np.cumsum(counts)
                words = [w for doc in split for w in doc]
                del split
                x = hashes_of(words, cache)
                found: list[tuple[int, int]] = []
                if len(x) >= WIDTH:
                    grams = rolling.windows(x, GRAM)
                    places = fingerprints(grams, WIDTH - GRAM + 1)
                    places = places[held(grams[places], 0)]
                    if len(places):
                        whole = rolling.windows(x, WIDTH)
                        near = np.unique(places[:, None] - np.arange(WIDTH - GRAM + 1))
                        near = near[(near >= 0) & (near < len(whole))]
                        found += [(s, WIDTH) for s in near[held(whole[near], WIDTH)].tolist()]
                for size in short:
                    found += [(s, size) for s in np.flatnonzero(held(rolling.windows(x, size), size)).tolist()]
                found.sort()
                owner = np.searchsorted(ends, [s for s, _ in found], "right") if found else []
                lists: dict[int, list[dict]] = {}
                for (s, size), doc in zip(found, owner):
                    if s + size <= ends[doc]:  # not across two documents
                        begin = s - int(ends[doc] - counts[doc])
                        lists.setdefault(int(doc), []).append({"start": begin, "size": size, "digest": digest(words[s : s + size])})
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(at, len(texts)),
                        pa.array(counts, pa.int64()),
                        pa.array([sha256(t).hexdigest() if i in lists else None for i, t in enumerate(texts)], pa.string()),
                        pa.array([lists.get(i, []) for i in range(len(texts))], _WINDOWS),
                    ],
                    ["doc_id", "n_words", "mark", "windows"],
                )

    return in_arrow(documents(docs), run, CANDIDATES)


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, mark, n_hit, the windows found as (start, size) in words, and the items they are of, sorted."""
    windows, bits = item_windows(items)
    short = sorted(r["size"] for r in windows.select("size").distinct().collect() if r["size"] < WIDTH)
    near = candidates(docs, bitmap(bits), short).withColumn("row", F.monotonically_increasing_id())
    near = written(near, "near")
    each = near.where(F.size("windows") > 0).select("row", F.explode("windows").alias("w")).select("row", "w.*")
    same = ["size", "digest"]
    places = each.join(windows.select(same).distinct(), same, "left_semi")
    places = places.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "size"))).alias("found"))
    named = each.select("row", *same).distinct().join(windows, same).groupBy("row")
    named = named.agg(F.array_sort(F.collect_set("item")).alias("items"))
    union = F.aggregate(
        "found",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, w: F.struct(
            (acc["n"] + F.greatest(F.lit(0), w["start"] + w["size"] - F.greatest(acc["to"], w["start"]))).alias("n"),
            F.greatest(acc["to"], w["start"] + w["size"]).alias("to"),
        ),
        lambda acc: acc["n"],
    )
    out = near.select("row", "doc_id", "n_words", "mark").join(places, "row", "left").join(named, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        "mark",
        F.coalesce(union.cast("long"), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("found", F.array().cast("array<struct<start:int,size:int>>")).alias("found"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated() -> Column:
    """The verdict over ``n_hit`` and ``n_words``."""
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows that are not contaminated, with all their columns. The verdict follows from the text, so texts are compared."""
    bad = written(hits(docs, items).where(contaminated()).select("mark").distinct(), "bad")
    sure, rest = touched(docs, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), bad)
    kept = rest.join(bad.withColumnRenamed("mark", "__mark"), "__mark", "left_anti").select(*docs.columns)
    return sure.unionByName(kept)
