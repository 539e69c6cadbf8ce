"""Periodic runs: maximal stretches of words that repeat with a period at least ``times`` times, from maximal pairs.

A run of period q is the same thing as a maximal pair at distance q: two places i and i + q whose texts agree for l words, not
for l + 1, and whose left words differ, with q + l >= max(least, times * q). So runs are read off the LCP-interval tree of the
suffix array and nothing is extended afterwards. Places are sorted by prefix doubling over whole slices of documents at once (the
document is part of the first rank, so no prefix crosses documents); the tree is walked bottom-up over intervals of at least the
smallest possible l. Every interval keeps its places in order, each with the class of its left word. Where a child joins, its
places meet the nearest places of the others, the smaller list walking through the larger: the partner of a run's first word is
always its nearest one, as a nearer one would be a smaller period. So n log n pairs are looked at, not all maximal pairs of a
frequent passage, and intervals whose nearest places are too far apart for their depth are left out before any walk.

A document is handled whole inside its task: about 4 bytes a word for each doubling of its longest repeat. No shuffle.

Defined cases: null text has no words and no runs, like an empty one; the collapsed text is then empty. Ties and equal rows give a
row each. Other columns of the table, under any name, stay out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import documents, in_arrow, slices

#: Words of a run at least, and repetitions of its period at least.
LEAST, TIMES = 6, 4
SHAPE = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
RUN = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])


def sorted_places(first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places in the order of their suffixes, and the ranks of their first 1, 2, 4... words, equal for equal words only.

    ``first`` ranks single words by (document, word), ``ends`` has the end of each place's document. A rank is the first index
    of its group in the order, so that groups are refined in place; those of one member are left alone.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    new = np.concatenate(([True], first[order][1:] != first[order][:-1])) if n else np.zeros(0, bool)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, width = [rank.copy()], 1
    open_ = np.arange(n)
    while len(open_):
        group = rank[order[open_]]
        size = np.bincount(group, minlength=n)
        open_ = open_[size[group] > 1]
        if not len(open_):
            break
        places = order[open_]
        after = np.where(places + width < ends[places], rank[np.minimum(places + width, n)], -1)
        key = rank[places].astype(np.int64) * (n + 1) + after + 1
        by = np.argsort(key, kind="stable")
        places, key = places[by], key[by]
        order[open_] = places
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[places] = np.maximum.accumulate(np.where(new, open_, 0))
        ranks.append(rank.copy())
        width *= 2
    return order, ranks


def common_words(a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """How many words from places ``a`` and ``b`` on agree."""
    n = len(ranks[0]) - 1
    length = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = np.minimum(a + length, n), np.minimum(b + length, n)
        length += (ranks[k][x] == ranks[k][y]).astype(np.int64) << k
    return length


def near_pairs(few: list[int], many: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs of next places, one of each list, in the union of two ascending lists."""
    for k, place in enumerate(few):
        at = bisect_left(many, place)
        if at and (not k or many[at - 1] > few[k - 1]):
            yield many[at - 1], place
        if at < len(many) and (k + 1 == len(few) or many[at] < few[k + 1]):
            yield place, many[at]


def joined(few: list[int], many: list[int]) -> list[int]:
    """The union of two ascending lists, made of the longer one."""
    if few[0] > many[-1]:
        many.extend(few)
    elif len(few) == 1:
        many.insert(bisect_left(many, few[0]), few[0])
    else:
        many.extend(few)
        many.sort()  # two ascending runs: one merge
    return many


def interval_pairs(places: list[int], depths: list[int], times: int) -> Iterator[tuple[int, int, int]]:
    """Next places (i, j) at the interval of depth l in which they meet, with j - i small enough for a run: bottom-up.

    ``depths`` has the common words of each place and the one before it in the order, the first being unused.
    """
    stack: list[tuple[int, list[int]]] = []

    def meet(a: list[int], b: list[int], depth: int) -> list[int]:
        few, many = (a, b) if len(a) < len(b) else (b, a)
        found.extend((i, j, depth) for i, j in near_pairs(few, many) if (times - 1) * (j - i) <= depth)
        return joined(few, many)

    found: list[tuple[int, int, int]] = []
    current = [places[0]]
    for place, depth in zip(places[1:], depths[1:]):
        while stack and stack[-1][0] >= depth:
            below, others = stack.pop()
            current = meet(others, current, below)
        stack.append((depth, current))
        current = [place]
    while stack:
        below, others = stack.pop()
        current = meet(others, current, below)
    yield from found


def find(lists: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(list, start, length, period) of the runs in lists of words, in that order."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    n = int(sizes.sum())
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    words = np.fromiter(map(numbers.__getitem__, chain.from_iterable(lists)), np.int64, n)
    ends_of = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(lists)), sizes)
    first = owner * max(len(numbers), 1) + words
    order, ranks = sorted_places(first, np.repeat(ends_of, sizes))
    shortest = min(max(least - q, (times - 1) * q) for q in range(1, max(least, 1) + 1))

    grams = ranks[min(shortest.bit_length() - 1, len(ranks) - 1)][order]
    at = np.flatnonzero(grams[1:] == grams[:-1]) + 1
    depth = np.zeros(n + 1, np.int64)
    depth[at] = common_words(order[at - 1], order[at], ranks)
    deep = depth[:n] >= shortest
    # An interval of places that share the first ``shortest`` words: index ``begin`` with no deep link, then deep ones up to ``stop``.
    edges = np.diff(np.concatenate((deep, [False])).astype(np.int8), prepend=0)
    begin, stop = np.flatnonzero(edges == 1) - 1, np.flatnonzero(edges == -1)
    if not len(begin):
        return (np.zeros(0, np.int64),) * 4
    inside = np.repeat(begin - np.concatenate(([0], np.cumsum(stop - begin)[:-1])), stop - begin) + np.arange((stop - begin).sum())
    label = np.repeat(np.arange(len(begin)), stop - begin)
    sort = np.lexsort((order[inside], label))
    gap = np.diff(order[inside][sort], prepend=0)
    heads = np.cumsum(stop - begin) - (stop - begin)
    gap[heads] = n
    close = (times - 1) * np.minimum.reduceat(gap, heads) <= np.maximum.reduceat(np.where(deep[inside], depth[inside], 0), heads)

    begin, stop = begin[close], stop[close]
    two = stop - begin == 2
    low, high = np.minimum(order[begin[two]], order[begin[two] + 1]), np.maximum(order[begin[two]], order[begin[two] + 1])
    found = [(low, high, depth[begin[two] + 1])]
    for b, s in zip(begin[~two].tolist(), stop[~two].tolist()):
        pairs = list(interval_pairs(order[b:s].tolist(), depth[b:s].tolist(), times))
        if pairs:
            found.append(tuple(np.array(pairs, np.int64).T))
    i, j, common = (np.concatenate(x) for x in zip(*found))
    period = j - i
    left = np.where(np.isin(i, ends_of - sizes), -1, first[np.maximum(i - 1, 0)]), first[np.maximum(j - 1, 0)]
    true = (left[0] != left[1]) & (common + period >= np.maximum(least, times * period))
    i, length, period = i[true], (common + period)[true], period[true]
    of = owner[i]
    start = i - (ends_of - sizes)[of]
    by = np.lexsort((period, start, of))
    return of[by], start[by], length[by], period[by]


def dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:n]) > 0


def runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, the runs by start and period, and the text (words joined by a blank) with each run cut to its first period."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch):
                lists = [(t or b"").split() for t in texts]
                of, *parts = find(lists, least, times)
                cuts = np.searchsorted(of, np.arange(len(lists) + 1))
                collapsed = []
                for k, words in enumerate(lists):
                    if cuts[k] < cuts[k + 1]:
                        gone = dropped(len(words), *(p[cuts[k] : cuts[k + 1]] for p in parts))
                        words = [w for w, out in zip(words, gone.tolist()) if not out]
                    collapsed.append(b" ".join(words))
                items = pa.StructArray.from_arrays([pa.array(p, pa.int64()) for p in parts], fields=list(RUN))
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(at, len(texts)),
                        pa.array(list(map(len, lists)), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), items),
                        pa.array(collapsed, pa.binary()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return in_arrow(documents(docs), work, SHAPE)


def longest() -> Column:
    """The run of greatest length, the first of equal ones (by start, then period); its fields are null without runs."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    return F.struct(*(f.alias(name) for f, name in zip((-best["col2"], best["length"], -best["col3"]), ("start", "length", "period"))))
