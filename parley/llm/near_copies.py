"""Near copies by the Jaccard similarity of word shingles: candidates from bands of min-hashes, decided by the shingles.

1. A text is the set of its ``width``-word shingles, 64-bit hashes. ``BANDS`` times ``ROWS`` min-hashes are its signature; the hash
   of each band's values is a bucket. Two texts of similarity s share a bucket with probability 1 - (1 - s^ROWS)^BANDS:
   0.9997 at 0.8.
2. Only distinct sets take part: exact copies, however many, are one of them. In a bucket each set is paired with the
   ``NEIGHBOURS`` before it in one order for all buckets. The sets of the paired texts are joined to the pairs, and a pair whose
   similarity is at least ``SIMILARITY`` is a link. Components are those of operator 2.
3. That makes a family of near copies one component with few pairs, but a link between sets further apart in a bucket is not looked
   at yet. So in every bucket that holds sets of several components, each set outside its largest component is paired with all sets
   of other components in the bucket, and those pairs are decided too. After that every two sets that share a bucket are either in
   one component or decided: nothing is left out, and no pairs within a component, nearly all of a large bucket, are made.

Pairs whose sizes rule the similarity out are left. In buckets of more than ``LARGE`` sets, what no other set of these buckets holds
counts as not shared: where a set has n shingles and c of them elsewhere too, two sets have a similarity of at most
min(c, c') / (n + n' - min(c, c')). A family of near copies is full of edits that occur once, so sets that can have no link, and nearly
all pairs that are none, go before pairs are made. There each set is also paired with the one of the greatest c / n, so that a
family comes together at once. The rows that a bucket sends to its outsiders are dealt into ``SALTS`` parts; there two sets are
a pair only if their sketches allow it. A sketch says of each of ``SKETCH_BITS`` classes of shingles whether the set has an odd number
of them, so the bits in which two sketches differ are at most the shingles in which the sets do, and no link is lost.

Words are those of operator 2: A-Z in lower case, anything but U+0009 to U+000D and space. Fewer than ``width`` words are one
shingle; null and blank texts have none and are copies of each other. Repeated rows, null ids and extra columns: as in
``simhash.one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import simhash
from parley.llm.common import Hashes, Rolling, documents, hashes_of, in_arrow, mixed, slices, touched, written
from parley.llm.components import components
from parley.llm.simhash import first_rows, mark_of

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
NEIGHBOURS = 3
#: Parts into which a bucket is dealt where its outsiders meet it.
SALTS = 8
#: Sets of a bucket from which on unique shingles are counted.
LARGE = 64
#: Bits of a sketch, in columns of 64.
SKETCH_BITS = 1024
SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]
#: Shingles that meet all hash functions at once, and bytes of sets that a comparison holds.
PART, HELD_BYTES = 1 << 10, 16 << 20
_FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(data: bytes | None, cache: Hashes, rolling: Rolling, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingles of a text."""
    words = data.lower().split() if data else []
    return np.unique(rolling.windows(hashes_of(words, cache), min(width, len(words))))


def signature(found: np.ndarray) -> np.ndarray:
    """A bucket per band."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(found), PART):
        # a product's low bits depend on little, so halves change places before the next product
        x = found[None, at : at + PART] * _FACTORS[:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, x.min(axis=1))
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)], np.uint64)


def sketch(found: np.ndarray) -> np.ndarray:
    """Whether the set has an odd number of shingles, by class."""
    odd = np.bincount((found % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def hashing() -> tuple[Hashes, Rolling]:
    return Hashes(), Rolling(0x9E3779B97F4A7C15)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, mark (of id and text), fp (128 bits of the set of shingles), its size n, buckets and sketch of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = hashing()
        for batch in batches:
            for at, texts in slices(batch):
                sets = [shingles(t, *tools) for t in texts]
                kept = (batch.column(c).slice(at, len(texts)) for c in ("doc_id", "mark"))
                fp = pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string())
                buckets = pa.array([signature(s).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64()))
                sizes, sketches = pa.array(map(len, sets), pa.int64()), pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))
                yield pa.record_batch([*kept, fp, sizes, buckets, sketches], ["doc_id", "mark", "fp", "n", "buckets", "sketch"])

    shape = "doc_id long, mark string, fp string, n long, buckets array<long>, sketch array<long>"
    return in_arrow(documents(docs).withColumn("mark", mark_of()), run, shape)


def buckets_of(marked: DataFrame) -> DataFrame:
    """(bucket, fp, n, sets) of the distinct sets, for buckets that hold several; ``sets`` is how many."""
    distinct = marked.groupBy("fp").agg(F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    spread = distinct.select("fp", "n", F.explode("buckets").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("sets")).where("sets > 1").select("bucket", "sets")
    # sized by the sets, of which each is in BANDS buckets: neither side is for a broadcast
    return spread.join(shared.hint("merge"), "bucket").select("bucket", "fp", "n", "sets")


def fits(one: str, two: str, similarity: float) -> Column:
    """Whether sets of these sizes can be so similar."""
    return F.least(one, two) >= similarity * F.greatest(one, two)


def candidates(shared: DataFrame, similarity: float) -> DataFrame:
    """(a, b) pairs of next sets of a bucket, a above b, and where ``c`` is known of each with the one of the largest share c of n."""
    order = Window.partitionBy("bucket").orderBy("fp")
    before = [F.lag(F.struct("fp", "n"), k).over(order) for k in range(1, NEIGHBOURS + 1)]
    if "c" in shared.columns:
        centre = F.max(F.when(F.col("c").isNotNull(), F.struct(F.col("c") / F.col("n"), "fp", "n"))).over(Window.partitionBy("bucket"))
        before.append(F.when(F.col("c").isNotNull(), F.struct(centre["fp"].alias("fp"), centre["n"].alias("n"))))
    near = shared.select("fp", "n", F.array(*before).alias("before"))
    near = near.select("fp", "n", F.explode("before").alias("b")).where("b.fp <> fp").where(fits("n", "b.n", similarity))
    return near.select(F.greatest("fp", "b.fp").alias("a"), F.least("fp", "b.fp").alias("b")).distinct()


def mixed_buckets(able: DataFrame, roots: DataFrame, marked: DataFrame) -> DataFrame:
    """(bucket, fp, n, c, root, main) and ``SKETCH`` of the buckets that hold several components, of which ``main`` is the largest."""
    named = able.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    sizes = named.groupBy("bucket", "root").agg(F.count("*").alias("sets"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("sets", "root")).alias("main"), F.count("*").alias("roots"))
    several = main.where("roots > 1").select("bucket", F.col("main.root").alias("main"))
    bits = marked.groupBy("fp").agg(F.first("sketch").alias("sketch"))
    bits = bits.select("fp", *(F.get("sketch", F.lit(k)).alias(name) for k, name in enumerate(SKETCH)))
    return named.join(several, "bucket").join(bits, "fp").select("bucket", "fp", "n", "c", "root", "main", *SKETCH)


def able_sets(shared: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """(bucket, fp, n, c) without those sets of large buckets that share too little with all others there; c is null in small ones."""
    rows = shared.join(sizes, "fp", "left").withColumn("c", F.when(F.col("sets") > LARGE, F.col("c")))
    return rows.where(F.col("c").isNull() | (F.col("c") >= similarity * F.col("n"))).select("bucket", "fp", "n", "c")


def shared_sizes(docs: DataFrame, marked: DataFrame, shared: DataFrame) -> DataFrame:
    """(fp, c): shingles of each set of the large buckets that another of these sets holds too."""
    ends = shared.where(F.col("sets") > LARGE).select("fp").distinct()
    sets = sets_of(docs, marked, written(ends, "large")).select(F.xxhash64("fp").alias("one"), "fp", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in slices(batch, "found", HELD_BYTES // 16):
                sizes = [len(r) // 8 for r in rows]
                one = np.repeat(batch.column("one").slice(at, len(rows)).to_numpy(), sizes)
                found = np.frombuffer(b"".join(rows), "<i8")
                yield pa.record_batch([pa.array(one), pa.array(found)], ["one", "shingle"])

    # two sets of one hash would only make shingles look shared that are not, which rules out less
    spread = in_arrow(sets.select("one", "found"), run, "one long, shingle long")
    held = spread.groupBy("shingle").agg(F.min("one").alias("one"), F.max("one").alias("other"))
    alone = held.where("one = other").groupBy("one").agg(F.count("*").alias("alone"))
    counted = sets.select("one", "fp", (F.octet_length("found") / 8).cast("long").alias("n")).join(alone, "one", "left")
    return counted.select("fp", F.greatest(F.lit(0), F.col("n") - F.coalesce("alone", F.lit(0))).alias("c"))


def outsiders(members: DataFrame, tried: DataFrame, similarity: float) -> DataFrame:
    """(a, b) pairs of sets that share a bucket, are in different components and are not among the pairs tried.

    ``members`` are ``mixed_buckets``; pairs that their sizes, what they share with any set or, in large buckets, their sketches
    rule out are left.
    """
    members = members.withColumn("large", F.col("c").isNotNull()).withColumn("c", F.coalesce("c", "n"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).drop("main")
    others = members.where("root <> main").withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    kept = {"fp": "x", "n": "nx", "c": "cx", "root": "rx", **{name: f"x{name}" for name in SKETCH}}
    others = others.select("bucket", "salt", *(F.col(name).alias(alias) for name, alias in kept.items()))
    most = F.least("c", "cx")
    possible = fits("n", "nx", similarity) & (most >= similarity * (F.col("n") + F.col("nx") - most))
    apart = reduce(add, (F.bit_count(F.col(name).bitwiseXOR(F.col(f"x{name}"))) for name in SKETCH))
    # a similarity of s leaves (1 - s) / (1 + s) of both sizes that only one of the sets holds; the rest is for rounding
    possible &= ~F.col("large") | (apart * (1 + similarity) <= (1 - similarity) * (F.col("n") + F.col("nx")) + 1e-6)
    # sized as if there were no SALTS copies
    met = others.hint("merge").join(salted, (others.bucket == salted.bucket) & (others.salt == salted.salt) & (F.col("rx") != F.col("root")) & possible)
    pairs = met.select(F.greatest("x", "fp").alias("a"), F.least("x", "fp").alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti")


def ends_of(pairs: DataFrame) -> DataFrame:
    """(fp) of all sets in ``pairs``."""
    return pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()


def sets_of(docs: DataFrame, marked: DataFrame, ends: DataFrame) -> DataFrame:
    """(fp, found) with the shingles of some sets (fp), taken from one row of each."""
    wanted = marked.groupBy("fp").agg(F.min("mark").alias("mark")).join(ends, "fp", "left_semi").select("fp", "mark")
    wanted = written(wanted, "wanted")
    _, rest = touched(docs, mark_of(), wanted)
    rows = rest.select("text", F.col("__mark").alias("mark")).join(wanted, "mark").select("fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = hashing()
        for batch in batches:
            for at, texts in slices(batch):
                found = pa.array([shingles(t, *tools).tobytes() for t in texts], pa.binary())
                yield pa.record_batch([batch.column("fp").slice(at, len(texts)), found], ["fp", "found"])

    return written(in_arrow(rows, run, "fp string, found binary").dropDuplicates(["fp"]), "sets")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


def links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets are as similar as that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, firsts in slices(batch, "found_a", HELD_BYTES):
                others = batch.column("found_b").slice(at, len(firsts))
                fine = [
                    jaccard(np.frombuffer(x, "<u8"), np.frombuffer(y.as_py(), "<u8")) >= similarity for x, y in zip(firsts, others)
                ]
                yield batch.slice(at, len(firsts)).select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    one, two = (sets.select(F.col("fp").alias(c), F.col("found").alias(f"found_{c}")) for c in "ab")
    return in_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "found_a", "found_b"), run, "a string, b string")


def all_links(docs: DataFrame, marked: DataFrame, similarity: float = SIMILARITY, known: DataFrame | None = None) -> DataFrame:
    """(a, b) links that decide the components of all candidate pairs of written signatures.

    ``known`` are links between sets that are found already; they are among the result.
    """
    shared = written(buckets_of(marked), "buckets")
    able = written(able_sets(shared, shared_sizes(docs, marked, shared), similarity), "able")
    first = written(candidates(able, similarity), "pairs")
    found = links(first, sets_of(docs, marked, ends_of(first)), similarity)
    found = written(found if known is None else found.unionByName(known), "first-links")
    members = written(mixed_buckets(able, components(found, "a", "b").withColumnRenamed("node", "fp"), marked), "members")
    rest = written(outsiders(members, first, similarity), "outsiders")
    return found.unionByName(links(rest, sets_of(docs, marked, ends_of(rest)), similarity))


def fingerprint_links(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(a, b) links between sets whose texts operator 2 puts in one component, each with the smallest of it."""
    prints = written(simhash.fingerprints(docs), "fingerprints")
    roots = simhash.labelled(prints).withColumnRenamed("fp", "print")
    by_mark = prints.groupBy("mark").agg(F.first("fp").alias("print")).join(roots, "print").select("mark", "root")
    sets = marked.select("fp", "mark").distinct().join(by_mark, "mark").select("fp", "root").distinct()
    least = sets.groupBy("root").agg(F.min("fp").alias("b"))
    return sets.join(least, "root").where("fp <> b").select(F.col("fp").alias("a"), "b")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, fingerprints: bool = False) -> DataFrame:
    """One row of each component, with all its columns, chosen as by ``simhash.one_of_each``.

    With ``fingerprints`` the links of operator 2 come first, and near copies are looked for between its components.
    """
    marked = written(signatures(docs), "signatures")
    known = written(fingerprint_links(docs, marked), "fingerprint-links") if fingerprints else None
    roots = components(all_links(docs, marked, similarity, known), "a", "b").withColumnRenamed("node", "fp")
    labels = marked.select("fp").distinct().join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return first_rows(docs, marked, labels)
