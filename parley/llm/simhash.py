"""SimHash near-dedup by anchor-point covering.

The anchors are pairs of words of the perfect binary Golay code of length 23, laid over the first 46 bits of a fingerprint:
2^24 anchors with covering radius 3 + 3. A fingerprint belongs to its nearest anchor and is replicated to every anchor within
the radius plus the threshold, about 80. If two fingerprints differ in at most ``threshold`` bits, the second is replicated to
the anchor that the first belongs to; so a join on the anchor, which compares whole fingerprints, finds every link. Only
distinct fingerprints take part: exact copies, however many, are one of them.

Fingerprints: texts with A-Z in lower case, words of anything but U+0009 to U+000D and space, ``SHINGLE``-word shingles with
repeats, XXH64 of each with seed 42; a bit is set if it is set in over half of them. Fewer words are one shingle; a null or
blank text has the fingerprint zero and links like any other.

Defined results: repeated rows are documents of their own; a null id is returned as it is and names a component only if no
other id is in it; extra columns are left out by ``groups`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import documents, in_arrow, slices, touched, written
from parley.llm.components import components

SHINGLE = 3
THRESHOLD = 2
SEED = 42
#: Length, dimension, covering radius and generator polynomial of the Golay code.
LENGTH, DIMENSION, RADIUS, GENERATOR = 23, 12, 3, 0b110001110101
#: Anchors of a fingerprint, about, and rows of them that a task makes.
REPLICAS, TASK_ROWS = 80, 4_000_000
#: Hashes that are unpacked to bits at once.
ROWS = 1 << 15


def fingerprint(data: bytes | None, width: int = SHINGLE) -> int:
    words = data.lower().split() if data else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(width, len(words)) - 1 :].tolist()
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[a:b], SEED) for a, b in zip(starts, stops)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, n, ROWS):
        part = hashes[at : at + ROWS].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def mark_of() -> Column:
    """What stands for a row: a hash of its id and text; rows that are equal in both have one mark."""
    return F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text").cast("binary"), 256)


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, mark (of id and text) and fp, the 64 bits as a signed long, of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch):
                fp = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
                kept = (batch.column(c).slice(at, len(texts)) for c in ("doc_id", "mark"))
                yield pa.record_batch([*kept, pa.array(fp)], ["doc_id", "mark", "fp"])

    return in_arrow(documents(docs).withColumn("mark", mark_of()), run, "doc_id long, mark string, fp long")


def codewords() -> np.ndarray:
    """All words of the code: the multiples of the generator, without carry."""
    message = np.arange(1 << DIMENSION, dtype=np.uint32)
    out = np.zeros_like(message)
    for bit in range(DIMENSION):
        out ^= np.where(message >> bit & 1, np.uint32(GENERATOR << bit), np.uint32(0))
    return out


def replicas(fp: np.ndarray, code: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor, whether it belongs to it) for all anchors within ``reach``."""
    mask = np.uint64((1 << LENGTH) - 1)
    far = [
        np.bitwise_count((fp >> np.uint64(shift) & mask).astype(np.uint32)[:, None] ^ code[None, :]) for shift in (0, LENGTH)
    ]
    least = [d.min(axis=1) for d in far]
    near = [np.nonzero(d <= (reach - other)[:, None]) for d, other in zip(far, reversed(least))]
    counts = [np.bincount(rows, minlength=len(fp)) for rows, _ in near]
    first = [np.concatenate(([0], np.cumsum(c)))[:-1] for c in counts]
    # every near word of the first half with every near word of the second
    left = np.repeat(np.arange(len(near[0][0])), counts[1][near[0][0]])
    owner = near[0][0][left]
    begin = np.concatenate(([0], np.cumsum(counts[1][near[0][0]])))[:-1]
    right = first[1][owner] + np.arange(len(left)) - begin[left]
    one, two = near[0][1][left], near[1][1][right]
    total = far[0][owner, one].astype(np.int64) + far[1][owner, two]
    ok = total <= reach
    owner, one, two = owner[ok], one[ok], two[ok]
    own = (far[0][owner, one] <= RADIUS) & (far[1][owner, two] <= RADIUS)
    return owner, one.astype(np.int64) << DIMENSION | two, own


def own_anchor(fp: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The anchor that each fingerprint belongs to: the only one within the radius in both halves, as the code is perfect."""
    mask = np.uint64((1 << LENGTH) - 1)
    one, two = (
        np.bitwise_count((fp >> np.uint64(shift) & mask).astype(np.uint32)[:, None] ^ code[None, :]).argmin(axis=1) for shift in (0, LENGTH)
    )
    return one.astype(np.int64) << DIMENSION | two


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) pairs of distinct fingerprints, a above b, that differ in at most ``threshold`` bits."""

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codewords()
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for at in range(0, len(fp), 256):
                part = fp[at : at + 256]
                index, anchor, _ = replicas(part.view(np.uint64), code, 2 * RADIUS + threshold)
                yield pa.record_batch([pa.array(anchor), pa.array(part[index])], ["anchor", "b"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codewords()
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for at in range(0, len(fp), 256):
                part = fp[at : at + 256]
                yield pa.record_batch([pa.array(own_anchor(part.view(np.uint64), code)), pa.array(part)], ["anchor", "a"])

    # A fingerprint of eight bytes becomes about a hundred rows: the number of tasks follows those, not the bytes that come in.
    spark = distinct.sparkSession
    rows = distinct.count() * REPLICAS
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    even = distinct.select("fp").repartition(parts, "fp")
    own, spread = in_arrow(even, placed, "anchor long, a long"), in_arrow(even, spread_out, "anchor long, b long")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    # Spark takes the replicas for as many as the fingerprints, and would broadcast some gigabytes of them
    return own.join(spread.hint("merge"), "anchor").where((F.col("b") < F.col("a")) & close).select("a", "b")


def labelled(marked: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fp, root) for every fingerprint of a written table."""
    distinct = marked.select("fp").distinct()
    roots = components(links(distinct, threshold), "a", "b").withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, and component_id, the smallest id that links reach."""
    marked = written(fingerprints(docs), "fingerprints")
    labels = labelled(marked, threshold)
    smallest = marked.groupBy("fp").agg(F.min("doc_id").alias("smallest"))
    named = labels.join(smallest, "fp").groupBy("root").agg(F.min("smallest").alias("component_id"))
    by_fp = labels.join(named, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, null ids last, then by a hash of the text."""
    marked = written(fingerprints(docs), "fingerprints")
    return first_rows(docs, marked, labelled(marked, threshold))


def first_rows(docs: DataFrame, marked: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that stay of written (doc_id, mark, fp) and the (fp, root) of every fp."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    by_fp = marked.groupBy("fp").agg(first.alias("first"))
    chosen = labels.join(by_fp, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.mark").alias("mark"))
    chosen = written(chosen, "chosen")
    counts = marked.groupBy("mark").agg(F.count("*").alias("n")).join(chosen.withColumn("stays", F.lit(True)), "mark", "left")
    concerned = written(counts.where("stays is null or n > 1").select("mark"), "concerned")
    sure, rest = touched(docs, mark_of(), concerned)
    kept = rest.join(chosen.withColumnRenamed("mark", "__mark"), "__mark", "left_semi").dropDuplicates(["__mark"])
    return sure.unionByName(kept.select(*docs.columns))
