"""Suffix-array dedup on bytes, over sampled suffixes.

A suffix array of every byte would move a hundred bytes for each. Here the suffixes are those at anchors: in each string of
``width`` bytes the anchor is the place of the smallest hash of a ``GRAM``-byte gram, the leftmost if several. Equal strings have
their anchor at the same offset, so every repeat of ``width`` bytes shows between two suffixes that begin at anchors, each with
the bytes before it (its context: all strings of which the place is the anchor).

1. Documents are dealt into groups. A group sends, per distinct (gram, context), two hashes. A context that occurs elsewhere
   as a whole is settled: all its strings repeat. A gram with a single context is settled too: nothing repeats.
2. Each distinct context of the other grams is sent once. Sampled splitters range-partition the suffixes by their leading bytes;
   a bucket sorts them by multikey quicksort, eight bytes at a time, forwards from the anchor and likewise backwards. Common
   prefixes of neighbours give the classes of suffixes that agree for any length, to both sides. A string repeats if another
   suffix is in its class to both sides. Equal grams have equal leading bytes, so the splitters never part what must be
   compared, and no bucket has to look beyond its boundaries.
3. A gram with more than ``HOT`` contexts would make a bucket large. Its strings are counted one by one by two hashes
   instead, in buckets of hash values, where a hot string is one entry per group.

Rows equal in id and text are one row with a count, as in ``substrings``. The texts are shuffled once, for all rounds (those of equal
rows twice); all but the table of equal rows is one plan, so a lost executor costs its own tasks only. What is settled by
hash rests on 120 bits; what suffixes decide is compared byte by byte.

Defined results: a null text is empty; a text shorter than ``width`` is kept; repeated rows are documents of their own, so they
remove each other; null ids stay null; extra columns are left out. A document is handled as a whole within its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import Rolling, covered, documents, in_arrow, mixed, runs, ship, slices
from parley.llm.substrings import GROUP_BYTES, counted_rows, each_row, in_order

GRAM = 64
#: Contexts of one gram that a bucket sorts.
HOT = 4096
#: One document in so many is read for the splitters, and bytes of text for which there is a bucket.
SAMPLED, BUCKET_BYTES = 64, 16 << 20
#: Leading bits of hashes that are the bucket of a round of hashes.
BITS = 8
MESSAGE = "bucket long, grp long, n long, idx binary, data binary"
RESULT = "doc_id long, n_bytes long, n_removed long, removed array<struct<start:int,end:int>>, kept binary, copies long"
_REMOVED = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: States of an anchor: nothing repeats, all does, suffixes decide, hashes decide.
NONE, ALL, SORTED, COUNTED = range(4)
PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


@lru_cache(2)
def hasher(k: int) -> tuple[np.ndarray, Rolling]:
    """A 64-bit value for each byte, and rolling hashes over them."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASES[k])), Rolling(_BASES[k])


def byte_windows(data: bytes, n: int, k: int) -> np.ndarray:
    values, rolling = hasher(k)
    return rolling.windows(values[np.frombuffer(data, np.uint8)], n)


def anchors(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last) start of the strings of each anchor, its place, and the hash of its gram."""
    if len(data) < width:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    grams = byte_windows(data, GRAM, 0)
    least = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    size, reach = 1, width - GRAM + 1
    while size < reach:
        step = min(size, reach - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    last = np.append(first[1:], len(place)) - 1
    return first, last, place[first], grams[place[first]]


class Survey:
    """The anchors of all documents of a group, in an order that is the same in each round."""

    def __init__(self, texts: list[bytes], width: int):
        found = [anchors(t, width) for t in texts]
        self.texts, self.width = texts, width
        self.doc = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
        self.first, self.last, self.place, gram = (
            np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4)
        )
        self.gram = gram.astype(np.uint64) >> np.uint64(8)

    def context(self, i: int) -> bytes:
        return self.texts[self.doc[i]][self.first[i] : self.last[i] + self.width]

    def pairs(self) -> np.ndarray:
        """(gram, context) hashes of each anchor."""
        out = np.zeros(len(self.doc), PAIR)
        out["a"] = self.gram
        out["b"] = [xxhash.xxh3_64_intdigest(self.context(i)) for i in range(len(self.doc))]
        return out


def message(bucket: list[int], grp: int, n: list[int], idx: list[bytes], data: list[bytes]) -> pa.Table:
    columns = (bucket, [grp] * len(bucket), n, idx, data)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({c.split()[0]: pa.array(v, t) for c, v, t in zip(MESSAGE.split(", "), columns, kinds)})


def hashed(pairs: np.ndarray, grp: int, above: int) -> pa.Table:
    """Sorted distinct pairs whose first value has 56 bits, a row per bucket of its leading bits; 14 bytes a pair."""
    bucket = (pairs["a"] >> np.uint64(56 - BITS)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    parts = np.split(pairs, cuts) if len(pairs) else []
    low = [np.ascontiguousarray(p["a"]).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for p in parts]
    data = [a + p["b"].tobytes() for a, p in zip(low, parts)]
    return message([above + int(bucket[c]) for c in (0, *cuts)] if parts else [], grp, [len(p) for p in parts], [b""] * len(parts), data)


def pairs_of(n: int, data: bytes) -> np.ndarray:
    out = np.zeros(n, PAIR)
    low = np.zeros((n, 8), np.uint8)
    low[:, :6] = np.frombuffer(data, np.uint8, 6 * n).reshape(n, 6)
    out["a"], out["b"] = low.view("<u8").ravel(), np.frombuffer(data, "<u8", offset=6 * n)
    return out


def first_of_runs(*columns: np.ndarray) -> np.ndarray:
    """For sorted rows, whether each begins a run of equal ones."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def places(begin: np.ndarray, anchors_: np.ndarray) -> np.ndarray:
    """Places of the strings of some anchors, one anchor after the other."""
    count = begin[anchors_ + 1] - begin[anchors_]
    ends = np.cumsum(count)
    return np.repeat(begin[anchors_] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def judged(table: pa.Table, most: int) -> pa.Table:
    """For the pairs of a bucket a byte each: 1 if other groups have it, 2 if it is to be sent, 4 if its gram has more than ``most``
    contexts. The smallest group of a pair sends it, in whatever order the rows came: a bucket that runs again names the same."""
    table = table.sort_by("grp")
    counts = table.column("n").to_pylist()
    every = np.concatenate([pairs_of(n, d) for n, d in zip(counts, table.column("data").to_pylist())])
    order = np.lexsort((every["b"], every["a"]))  # stable: the first row of a run is the smallest group's
    a, b = every["a"][order], every["b"][order]
    new = first_of_runs(a, b)
    run = np.cumsum(new) - 1
    gram = np.cumsum(first_of_runs(a)) - 1
    contexts = np.bincount(gram, new)[gram]
    code = (np.bincount(run)[run] > 1) | ((new & (contexts > 1)).astype(np.uint8) << 1) | ((contexts > most).astype(np.uint8) << 2)
    out = np.zeros(len(order), np.uint8)
    out[order] = code
    return table.set_column(4, "data", pa.array([p.tobytes() for p in np.split(out, np.cumsum(counts)[:-1])], pa.binary()))


# --- sorting suffixes ------------------------------------------------------------------------------


def sort_strings(strings: list[bytes], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and the length of the common prefix of each with the one before it in that order.

    Multikey quicksort with keys of eight bytes: strings that are equal so far go on to the next key together, all such runs
    at once. A string that ends is filled with zeros and comes before those it begins.
    """
    size = np.array([len(s) for s in strings])
    keys = -(-longest // 8)
    matrix = np.frombuffer(b"".join(s.ljust(8 * keys, b"\0") for s in strings), ">u8").reshape(len(strings), keys)
    order = np.lexsort((size,))
    equal = np.zeros(len(strings), np.int64)  # keys in common with the one before
    run = np.zeros(len(strings), np.int64)  # number of the run of equal strings, by place in the order
    open_ = np.arange(len(strings))  # places in runs of two or more
    for key in range(keys):
        if len(open_) < 2:
            break
        values = matrix[order[open_], key].astype(np.uint64)
        within = np.lexsort((values, run[open_]))
        order[open_] = order[open_][within]
        values, same_run = values[within], run[open_]
        joined = np.zeros(len(open_), bool)
        joined[1:] = (values[1:] == values[:-1]) & (same_run[1:] == same_run[:-1])
        equal[open_[joined]] = key + 1
        number = np.cumsum(~joined)
        kept = joined.copy()
        kept[:-1] |= joined[1:]
        run[open_] = number
        open_ = open_[kept]
    common = 8 * equal
    part = np.flatnonzero(equal < keys)
    part = part[part > 0]
    differ = matrix[order[part], equal[part]].astype(np.uint64) ^ matrix[order[part - 1], equal[part]].astype(np.uint64)
    exact = np.zeros(len(part), np.int64)
    for k in range(8):
        exact += (differ >> np.uint64(56 - 8 * k) == 0) & (exact == k)
    common[part] += exact
    common[0] = 0
    if len(strings) > 1:
        common[1:] = np.minimum(common[1:], np.minimum(size[order[1:]], size[order[:-1]]))
    return order, common


def repeats(contexts: list[bytes], before: np.ndarray, width: int) -> list[np.ndarray]:
    """For each context, with ``before`` bytes ahead of its anchor, whether each of its strings is in another."""
    n = len(contexts)
    count = np.array([len(c) for c in contexts]) - width + 1
    ahead = [c[b:] for c, b in zip(contexts, before.tolist())]
    back = [c[:b][::-1] for c, b in zip(contexts, before.tolist())]
    ways = [sort_strings(ahead, width), sort_strings(back, width)]
    out = [np.zeros(k, bool) for k in count.tolist()]
    rank = []
    for order, _ in ways:
        at = np.empty(n, np.int64)
        at[order] = np.arange(n)
        rank.append(at)
    flat = np.concatenate(out) if n else np.zeros(0, bool)
    begin = np.concatenate(([0], np.cumsum(count)))[:-1]
    for back_by in range(int(before.max()) + 1 if n else 0):  # bytes of a string that lie before its anchor
        own = np.flatnonzero((before >= back_by) & (before - back_by < count))
        if len(own) < 2:
            continue
        classes = [np.cumsum(common < need) for (_, common), need in zip(ways, (width - back_by, back_by))]
        key = classes[0][rank[0][own]] * np.int64(n + 1) + classes[1][rank[1][own]]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = np.zeros(len(own), bool)
        hit[by[1:][same]] = True
        hit[by[:-1][same]] = True
        own = own[hit]
        flat[begin[own] + before[own] - back_by] = True
    return np.split(flat, begin[1:]) if n else []


def sorted_out(table: pa.Table, width: int) -> pa.Table:
    """For the contexts of a bucket of suffixes, a bit per string."""
    contexts, before, counts = [], [], []
    for n, data in zip(table.column("n").to_pylist(), table.column("data").to_pylist()):
        head = np.frombuffer(data, "<u4", 2 * n).astype(np.int64)
        ends = 8 * n + np.concatenate(([0], np.cumsum(head[:n])))
        contexts += [data[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
        before.append(head[n:])
        counts.append(n)
    found = repeats(contexts, np.concatenate(before), width)
    bits, at = [], 0
    for n in counts:
        bits.append(np.packbits(np.concatenate(found[at : at + n])).tobytes())
        at += n
    return table.set_column(4, "data", pa.array(bits, pa.binary()))


def counted(table: pa.Table) -> pa.Table:
    """For the strings of hot grams in a bucket, a byte per pair of hashes: whether other groups have it."""
    done = judged(table, HOT)
    bits = [(np.frombuffer(d, np.uint8) & 1).tobytes() for d in done.column("data").to_pylist()]
    return done.set_column(4, "data", pa.array(bits, pa.binary()))


def splitters(rows: DataFrame, width: int, buckets: int) -> np.ndarray:
    """Leading bytes of suffixes, as big-endian numbers, that part the suffixes of a sample of documents evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch):
                for t in texts:
                    place = anchors(t or b"", width)[2]
                    lead = [int.from_bytes(t[p : p + 8], "big") >> 1 for p in place.tolist()]
                    yield pa.record_batch([pa.array(lead, pa.int64())], ["lead"])

    shares = [k / buckets for k in range(1, buckets)]
    part = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    cuts = in_arrow(part, run, "lead long").agg(F.percentile_approx("lead", shares, F.lit(100 * buckets))).first()[0]
    return np.array(sorted(set(cuts or [])), np.int64)


def repeated(docs: DataFrame, width: int, group_bytes: int = GROUP_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, the removed intervals of bytes and the bytes that are left."""
    if width < 2 * GRAM:
        raise ValueError(f"strings shorter than {2 * GRAM} bytes have no room for an anchor")
    ship(docs.sparkSession)
    rows = documents(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(8, -(-size // group_bytes))
    buckets = max(8, -(-size // BUCKET_BYTES))
    cuts = splitters(rows, width, buckets)
    hashes, strings = 0, 1 << 40  # buckets of pairs, of counted strings; suffixes come in between
    suffixes = 1 << 20
    dealt = counted_rows(rows).withColumn("grp", F.pmod(F.xxhash64("doc_id", "text", "part"), F.lit(groups)))

    def first(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = Survey([r[1] for r in in_order(table)], width)
        return hashed(np.unique(own.pairs()), key[0].as_py(), hashes)

    def first_answer(table: pa.Table) -> pa.Table:
        return judged(table, hot)

    def second(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return message([], 0, [], [], [])
        grp = key[0].as_py()
        rows = in_order(left)
        own = Survey([r[1] for r in rows], width)
        pairs, index, inverse, times = np.unique(own.pairs(), return_index=True, return_inverse=True, return_counts=True)
        answers = sorted(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist()))
        code = np.frombuffer(b"".join(d for _, d in answers), np.uint8)
        again = np.array([r[3] for r in rows], bool)[own.doc]  # a document with copies is elsewhere as a whole
        settled = (code & 1 > 0) | (times > 1) | (np.bincount(inverse.ravel(), again, len(pairs)) > 0)
        sent, many = code & 2 > 0, code & 4 > 0
        state = np.full(len(pairs), NONE, np.uint8)
        state[sent & ~settled] = SORTED
        state[sent & ~settled & many] = COUNTED
        state[settled] = ALL
        heavy = index[sent & many]
        out = [message([-1 - grp], grp, [len(inverse)], [heavy.astype("<u4").tobytes()], [state[inverse.ravel()].tobytes()])]
        chosen = index[sent & ~many]
        if len(chosen):
            lead = np.array([int.from_bytes(own.texts[own.doc[i]][own.place[i] : own.place[i] + 8], "big") >> 1 for i in chosen])
            bucket = np.searchsorted(cuts, lead, "right")
            for b in np.unique(bucket).tolist():
                mine = chosen[bucket == b]
                texts = [own.context(i) for i in mine]
                head = np.concatenate(([len(t) for t in texts], own.place[mine] - own.first[mine])).astype("<u4")
                data = head.tobytes() + b"".join(texts)
                out.append(message([suffixes + b], grp, [len(mine)], [mine.astype("<u4").tobytes()], [data]))
        if len(heavy):
            out.append(hashed(np.unique(strings_of(own, heavy)), grp, strings))
        return pa.concat_tables(out)

    def strings_of(own: Survey, chosen: np.ndarray) -> np.ndarray:
        """Two hashes of each string of some anchors."""
        parts = []
        for i in chosen:
            pair = np.zeros(own.last[i] - own.first[i] + 1, PAIR)
            pair["a"] = byte_windows(own.context(i), width, 0) >> np.uint64(8)
            pair["b"] = byte_windows(own.context(i), width, 1)
            parts.append(pair)
        return np.concatenate(parts) if parts else np.zeros(0, PAIR)

    def second_answer(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return table
        return counted(table) if bucket >= strings else sorted_out(table, width)

    def third(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        rows = in_order(left)
        texts = [r[1] for r in rows]
        own = Survey(texts, width)
        n = len(own.doc)
        count = own.last - own.first + 1
        begin = np.concatenate(([0], np.cumsum(count)))
        flags = np.zeros(int(begin[-1]), bool)
        state, heavy, others = np.zeros(n, np.uint8), np.zeros(0, np.int64), []
        for bucket, idx, data in sorted(zip(*(right.column(c).to_pylist() for c in ("bucket", "idx", "data")))):
            sent = np.frombuffer(idx, "<u4").astype(np.int64)
            if bucket < 0:
                state, heavy = np.frombuffer(data, np.uint8), sent
            elif bucket >= strings:
                others.append(data)
            else:
                bits = np.unpackbits(np.frombuffer(data, np.uint8), count=int(count[sent].sum())).astype(bool)
                flags[places(begin, sent)] = bits
        flags |= np.repeat(state == ALL, count)
        if len(heavy):
            _, inverse, times = np.unique(strings_of(own, heavy), return_inverse=True, return_counts=True)
            often = np.frombuffer(b"".join(others), np.uint8).astype(bool) | (times > 1)
            flags[places(begin, heavy)] |= often[inverse.ravel()]
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "removed", "kept", "copies")}
        hits = np.flatnonzero(flags)
        anchor = np.searchsorted(begin, hits, "right") - 1
        hits += own.first[anchor] - begin[anchor]
        cut = np.searchsorted(own.doc[anchor], np.arange(len(texts) + 1))
        for k, (doc_id, text, copies, _) in enumerate(rows):
            gone = covered(hits[cut[k] : cut[k + 1]], width, len(text))
            a, b = runs(gone)
            out["doc_id"].append(doc_id)
            out["n_bytes"].append(len(text))
            out["n_removed"].append(int(gone.sum()))
            out["removed"].append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
            out["kept"].append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            out["copies"].append(copies)
        kinds = (pa.int64(), pa.int64(), pa.int64(), _REMOVED, pa.binary(), pa.int64())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})

    by_group = dealt.groupBy("grp")
    once = by_group.applyInArrow(first, MESSAGE).groupBy("bucket").applyInArrow(first_answer, MESSAGE)
    twice = by_group.cogroup(once.groupBy("grp")).applyInArrow(second, MESSAGE)
    twice = twice.groupBy("bucket").applyInArrow(second_answer, MESSAGE)
    return each_row(by_group.cogroup(twice.groupBy("grp")).applyInArrow(third, RESULT))
