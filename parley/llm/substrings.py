"""Substring dedup on words: Rabin-Karp hashes of every window of ``width`` words, counted over all documents.

Documents are dealt into groups of a few MB. A group sends the distinct hashes of its windows, cut to 56 bits and packed into
one array per bucket of leading bits; a bucket counts in how many groups a hash occurs and answers each group with one bit
per hash. Hashes that repeat are checked in a second round of the same kind with an independent 64-bit hash, so that a chance
collision of the first is not taken for a copy. Windows that repeat merge into maximal intervals of words to remove.

A copy that is found a million times is one entry per group and bucket, so no key is hot. Rows equal in id and text are one row
with a count, or one per ``COPIES`` of them, so they are no hot group either; each is a row of the result again. The texts are
shuffled once, for all rounds (those of equal rows twice); nothing but packed hashes and bits moves besides. All but the table of
equal rows is one plan, so a lost executor costs its own tasks only.

Defined results: a null or empty text has no words and an empty rest; repeated rows are documents of their own, so they remove
each other's windows; a null id stays null; extra columns are left out. Windows are judged on the input. Words are runs of
anything but U+0009 to U+000D and space. A document is handled as a whole within its task.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import Hashes, Rolling, covered, documents, hashes_of, pieces, runs, ship, touched, written
from parley.llm.simhash import mark_of

#: Bytes of text in a group.
GROUP_BYTES = 8 << 20
#: Hashes that a bucket should hold at most.
BUCKET_HASHES = 8 << 20
#: Equal rows that one row stands for at most.
COPIES = 10_000
#: Odd bases of the two rounds.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bits of a hash that are sent: those of the bucket and six bytes.
SENT = 48
PACKED = "bucket long, grp long, n long, data binary"
RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept string, copies long"
_REMOVED = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


@lru_cache(2)
def hasher(k: int) -> tuple[Hashes, Rolling]:
    return Hashes(k + 1), Rolling(BASES[k])


def counted_rows(rows: DataFrame) -> DataFrame:
    """doc_id, text, copies, again, part: rows that are equal in both are one, or one ``part`` per ``COPIES`` of them.

    ``again`` says whether there are several. Only texts of rows that the filter of repeated marks names are shuffled.
    """
    several = rows.groupBy(mark_of().alias("mark")).agg(F.count("*").alias("n")).where("n > 1")
    alone, rest = touched(rows, mark_of(), written(several, "equal-rows"))
    firsts = [F.first(c).alias(c) for c in ("doc_id", "text")]  # equal in all rows of a mark
    rest = rest.groupBy("__mark").agg(*firsts, F.count("*").alias("n"))
    rest = rest.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    copies = F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES).cast("long")
    rest = rest.select("doc_id", "text", copies.alias("copies"), (F.col("n") > 1).alias("again"), "part")
    one = (F.lit(1).cast("long").alias("copies"), F.lit(False).alias("again"), F.lit(0).cast("long").alias("part"))
    return alone.select("doc_id", "text", *one).unionByName(rest)


def each_row(found: DataFrame) -> DataFrame:
    """The result rows, as often as there were equal documents."""
    shown = [c for c in found.columns if c != "copies"]
    return found.select(*shown, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("__copy")).select(*shown)


def in_order(table: pa.Table) -> list[tuple]:
    """The documents of a group, with ``copies`` and ``again`` if they are counted rows, in an order that is the same in each round."""
    texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
    counted = [table.column(c).to_pylist() for c in ("copies", "again") if c in table.column_names]
    rows = zip(table.column("doc_id").to_pylist(), texts, *counted)
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def word_hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one after another, and the number of words of each text."""
    cache, _ = hasher(k)
    parts, counts = [], []
    for text in texts:
        n = 0
        for piece in pieces(text):
            words = piece.split()
            parts.append(hashes_of(words, cache))
            n += len(words)
        counts.append(n)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(counts, np.int64)


def whole_windows(counts: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows that lie in one text."""
    ends = np.cumsum(counts)
    n = int(ends[-1]) if len(ends) else 0
    start = np.arange(max(0, n - width + 1))
    return start[start + width <= np.repeat(ends, counts)[: len(start)]]


def packed(values: np.ndarray, grp: int, bits: int) -> pa.Table:
    """Sorted distinct values of ``SENT + bits`` bits, a row per bucket of their leading ``bits``."""
    bucket = (values >> np.uint64(SENT)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    firsts = np.concatenate(([0], cuts)) if len(values) else cuts
    low = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : SENT // 8]
    return pa.table(
        {
            "bucket": pa.array(bucket[firsts], pa.int64()),
            "grp": pa.array([grp] * len(firsts), pa.int64()),
            "n": pa.array(np.diff(np.append(firsts, len(values))), pa.int64()),
            "data": pa.array([p.tobytes() for p in np.split(low, cuts)] if len(values) else [], pa.binary()),
        }
    )


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // (SENT // 8), 8), np.uint8)
    out[:, : SENT // 8] = np.frombuffer(data, np.uint8).reshape(-1, SENT // 8)
    return out.view("<u8").ravel()


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(of):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return of[at] == values


def with_copies(found: np.ndarray, rows: list[tuple], counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the windows at ``starts`` and how often each occurs; a document with copies counts twice."""
    again = np.repeat(np.array([r[3] for r in rows], bool), counts)[starts]
    return np.unique(np.concatenate((found, found[again])), return_counts=True)


def answer(table: pa.Table) -> pa.Table:
    """For the arrays of a bucket, a bit per hash: whether another group has it. What has a negative bucket is passed on."""
    if table.num_rows == 0 or table.column("bucket")[0].as_py() < 0:
        return table
    arrays = [unpacked(d.as_py()) for d in table.column("data")]
    every = np.sort(np.concatenate(arrays))
    often = np.unique(every[1:][every[1:] == every[:-1]])
    bits = [np.packbits(member(a, often)).tobytes() for a in arrays]
    return table.set_column(3, "data", pa.array(bits, pa.binary()))


def answered(table: pa.Table) -> np.ndarray:
    """The bits of a group in order of its hashes."""
    rows = sorted(r for r in zip(*(table.column(c).to_pylist() for c in ("bucket", "n", "data"))) if r[0] >= 0)
    parts = [np.unpackbits(np.frombuffer(d, np.uint8), count=n) for _, n, d in rows]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def repeated(docs: DataFrame, width: int, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, the removed intervals of words and the kept words, joined by one space."""
    ship(docs.sparkSession)
    rows = documents(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(8, -(-size // group_bytes))
    bits = max(8, (size // 4 // BUCKET_HASHES).bit_length())
    shift = np.uint64(64 - SENT - bits)
    dealt = counted_rows(rows).withColumn("grp", F.pmod(F.xxhash64("doc_id", "text", "part"), F.lit(groups)))

    def first(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x, counts = word_hashes([r[1] for r in in_order(table)], 0)
        found = hasher(0)[1].windows(x, width)[whole_windows(counts, width)]
        return packed(np.unique(found >> shift), key[0].as_py(), bits)

    def second(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return packed(np.zeros(0, np.uint64), 0, bits)
        rows = in_order(left)
        texts = [r[1] for r in rows]
        x, counts = word_hashes(texts, 0)
        starts = whole_windows(counts, width)
        found = hasher(0)[1].windows(x, width)[starts] >> shift
        own, times = with_copies(found, rows, counts, starts)
        often = own[answered(right) | (times > 1)] if len(own) else own
        maybe = member(found, often)
        grp = key[0].as_py()
        other = check(texts, counts, starts[maybe])
        out = packed(np.unique(other >> shift), grp, bits)
        mask = np.packbits(maybe).tobytes()
        return pa.concat_tables([out, pa.table({"bucket": [-1 - grp], "grp": [grp], "n": [len(maybe)], "data": [mask]}, out.schema)])

    def check(texts: list[bytes], counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The second hash of the windows at ``starts``; only texts that have one are split."""
        ends = np.cumsum(counts)
        needed = np.zeros(len(texts), bool)
        needed[np.searchsorted(ends, starts, "right")] = True
        x, _ = word_hashes([t if need else b"" for t, need in zip(texts, needed)], 1)
        gone = np.where(needed, 0, counts)
        shifted = starts - np.concatenate(([0], np.cumsum(gone)))[np.searchsorted(ends, starts, "right")]
        return hasher(1)[1].windows(x, width)[shifted] if len(starts) else np.zeros(0, np.uint64)

    def third(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        rows = in_order(left)
        texts = [r[1] for r in rows]
        counts = np.array([sum(len(p.split()) for p in pieces(t)) for t in texts], np.int64)
        starts = whole_windows(counts, width)
        for bucket, n, data in zip(*(right.column(c).to_pylist() for c in ("bucket", "n", "data"))):
            if bucket < 0:
                starts = starts[np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)]
        other = check(texts, counts, starts) >> shift
        own, times = with_copies(other, rows, counts, starts)
        if len(own):
            starts = starts[member(other, own[answered(right) | (times > 1)])]
        gone = covered(starts, width, int(counts.sum()))
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_words", "n_removed", "removed", "kept", "copies")}
        at = 0
        for (doc_id, text, copies, _), n in zip(rows, counts.tolist()):
            flags = gone[at : at + n]
            at += n
            begin, end = runs(flags)
            kept, k = [], 0
            for piece in pieces(text):
                words = piece.split()
                if flags[k : k + len(words)].any():
                    words = [w for w, f in zip(words, flags[k : k + len(words)].tolist()) if not f]
                    k += len(piece.split())
                else:
                    k += len(words)
                if words:
                    kept.append(b" ".join(words))
            out["doc_id"].append(doc_id)
            out["n_words"].append(n)
            out["n_removed"].append(int(flags.sum()))
            out["removed"].append([{"start": a, "end": b} for a, b in zip(begin.tolist(), end.tolist())])
            out["kept"].append(b" ".join(kept).decode())
            out["copies"].append(copies)
        kinds = (pa.int64(), pa.int64(), pa.int64(), _REMOVED, pa.string(), pa.int64())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})

    by_group = dealt.groupBy("grp")
    once = by_group.applyInArrow(first, PACKED).groupBy("bucket").applyInArrow(answer, PACKED)
    twice = by_group.cogroup(once.groupBy("grp")).applyInArrow(second, PACKED)
    twice = twice.groupBy("bucket").applyInArrow(answer, PACKED)
    return each_row(by_group.cogroup(twice.groupBy("grp")).applyInArrow(third, RESULT))
