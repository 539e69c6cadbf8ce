"""Source divergence audit: word shares of each (lang, source) group against the other sources and against the whole language.

A pass over the documents counts terms per group and flushes its counts when it holds ``HELD`` of them; Spark sums them. Terms in
at least ``least`` documents of a language are numbered within blocks of that language (by hash, about ``BLOCK`` terms each), and a
group's counts of a block become one sorted sparse array. For every unordered pair of sources and every block the two arrays meet
in a join on the pair; a galloping intersection prices shared terms, then one-sided ones, both at once for either direction; terms
that neither source has are priced by their number. So no task holds more than two blocks, whatever the vocabulary, and a hot
source is no larger than any other after the first sum. There are as many pairs as the result has rows for them, half of it.

Shares are p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)) in integers: long division digit by digit in the pair tasks, whole
numbers of 38 digits in Spark, so sums to 9e16 words are exact.

Defined cases: null text, lang and source count as ''. A group without terms still has its rows: pairs with all sources of its
language, value 0 if the language keeps no term. Repeated rows are documents of their own. Extra columns stay out.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import in_arrow, slices, written

SCALE, PRIOR = 10**9, 5
#: Documents of a language that a kept term is in, and terms listed for a group.
LEAST, TOP = 30, 50
#: Counts that a task holds before it sends them on.
HELD = 300_000
#: Terms of a block, about.
BLOCK = 32_768
#: Parts into which the sources of a language are dealt where pairs are made.
SALTS = 16

#: A-Z in lower case, everything that is no letter and below U+0080 a blank.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n occurrences and df documents, in parts; a null term with df = 1 stands for each group met."""
    shape = "lang string, source string, term binary, n long, df long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                terms = [None, *n]
                columns = [[lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [1, *map(df.__getitem__, n)]]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            held.clear()

        names = ["lang", "source", "term", "n", "df"]
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for at, texts in slices(batch):
                for group, text in zip(zip(langs[at:], sources[at:]), texts):
                    n, df = held[group]
                    words = (text or b"").translate(_TERMS).split()
                    n.update(words)
                    df.update(set(words))
                if sum(len(n) + 1 for n, _ in held.values()) > HELD:
                    yield from flush()
        yield from flush()

    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c)
    return in_arrow(docs.select(blank("lang"), blank("source"), blank("text")), work, shape)


def shares(counts: np.ndarray, below: int) -> np.ndarray:
    """1 + floor(SCALE * (counts + PRIOR) / below), by long division: no product goes over ten times ``below``."""
    rest, out = counts + PRIOR, np.zeros(len(counts), np.int64)
    out += SCALE * (rest // below)
    rest = rest % below
    digits = np.zeros(len(counts), np.int64)
    for _ in range(len(str(SCALE)) - 1):
        rest = rest * 10
        digits = digits * 10 + rest // below
        rest = rest % below
    return 1 + out + digits


def share(count: Column, below: Column) -> Column:
    """The same for columns."""
    top = (count + F.lit(PRIOR)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", top, below.cast("decimal(20,0)"))


def gallop(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each of ``few`` the first place in ``many`` that holds no less; both ascend.

    All start where an even spread would have them, double their step until the place lies between, and halve it again.
    """
    n = len(many)
    padded = np.append(many, np.iinfo(many.dtype).max)
    low = np.arange(len(few)) * n // max(len(few), 1)
    high, step = low.copy(), 1
    while (back := (low > 0) & (padded[np.maximum(low - 1, 0)] >= few)).any():
        low[back] = np.maximum(low[back] - step, 0)
        step *= 2
    step = 1
    while (on := (high < n) & (padded[high] < few)).any():
        high[on] = np.minimum(high[on] + step, n)
        step *= 2
    while (open_ := low < high).any():
        middle = (low + high) // 2
        less = open_ & (padded[middle] < few)
        high = np.where(open_ & ~less, middle, high)
        low = np.where(less, middle + 1, low)
    return low


def price(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], below_a: int, below_b: int) -> tuple[int, int]:
    """Sum of |p - q| over the terms that either array of (ids, counts) has, and how many those are."""
    if len(a[0]) > len(b[0]):
        a, b, below_a, below_b = b, a, below_b, below_a
    at = gallop(a[0], b[0])
    both = (at < len(b[0])) & (b[0][np.minimum(at, len(b[0]) - 1)] == a[0]) if len(b[0]) else np.zeros(len(a[0]), bool)
    p, q = shares(a[1], below_a), shares(b[1], below_b)
    none = np.zeros(1, np.int64)
    p0, q0 = int(shares(none, below_a)[0]), int(shares(none, below_b)[0])
    alone = np.ones(len(b[0]), bool)
    alone[at[both]] = False
    value = np.abs(p[both] - q[at[both]]).sum() + np.abs(p[~both] - q0).sum() + np.abs(q[alone] - p0).sum()
    return int(value), len(a[0]) + int(alone.sum())


def price_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, a, b, value and number of terms of one block, for rows of two sparse arrays of which one may be null."""

    def of(column: str, i: int, kind: type) -> np.ndarray:
        found = batch.column(column)[i]
        return np.asarray(found.values, kind) if found.is_valid else np.zeros(0, kind)

    for batch in batches:
        below = list(zip(batch.column("below_a").to_pylist(), batch.column("below_b").to_pylist()))
        rows = [
            price(*((of(f"ids_{x}", i, np.int64), of(f"counts_{x}", i, np.int64)) for x in "ab"), *below[i])
            for i in range(batch.num_rows)
        ]
        value, terms = (pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1))
        yield pa.record_batch([*(batch.column(c) for c in ("lang", "a", "b")), value, terms], ["lang", "a", "b", "value", "terms"])


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank, as the module describes.

    ``pair``: each other source of the language, with the sum of |p - q| over its kept terms. ``term``: the ``top`` terms that the
    group has and that it uses more than its language does. Counts and numbered terms are written to the shared folder once.
    """
    summed = count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    counts = written(summed.withColumn("term", F.col("term").cast("string")), "divergence-counts")
    met = counts.where(F.col("term").isNotNull())
    by_term = met.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).where(F.col("df") >= least)
    by_term = written(by_term.drop("df"), "divergence-terms")

    sizes = by_term.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_sum"))
    blocks = max(1, -(-(sizes.agg(F.max("v")).first()[0] or 0) // BLOCK))
    numbered = by_term.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    numbered = numbered.withColumn("id", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")))
    kept = met.join(numbered, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "block", "id")

    groups = counts.where(F.col("term").isNull()).select("lang", "source")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "v", "lang_sum"])
    groups = written(groups.withColumn("below", F.col("total") + PRIOR * F.col("v")), "divergence-groups")
    return pair_rows(kept, groups).unionByName(term_rows(kept, groups, top))


def pair_rows(kept: DataFrame, groups: DataFrame) -> DataFrame:
    arrays = kept.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("cells"))
    arrays = arrays.select("lang", "source", "block", F.col("cells.id").alias("ids"), F.col("cells.n").alias("counts"))

    def side(name: str) -> DataFrame:
        return groups.select("lang", F.col("source").alias(name), F.col("below").alias(f"below_{name}"), "v")

    salts = F.explode(F.array(*(F.lit(i) for i in range(SALTS))))
    left = side("a").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    pairs = left.join(side("b").drop("v").withColumn("salt", salts), ["lang", "salt"]).where("a < b").drop("salt")

    def cells(name: str) -> DataFrame:
        own = [F.col(c).alias(f"{c}_{name}") for c in ("ids", "counts")]
        return arrays.select("lang", F.col("source").alias(name), "block", *own).join(pairs.drop("v"), ["lang", name])

    below = ["below_a", "below_b"]
    met = cells("a").join(cells("b"), ["lang", "a", "b", "block", *below], "full")
    met = met.select("lang", "a", "b", *below, "ids_a", "counts_a", "ids_b", "counts_b")
    priced = in_arrow(met, price_rows, "lang string, a string, b string, value long, terms long")
    priced = priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    whole = pairs.join(priced, ["lang", "a", "b"], "left").na.fill(0, ["value", "terms"])
    zero = [share(F.lit(0), F.col(c)) for c in below]
    absent = (F.col("v") - F.col("terms")) * F.abs(zero[0] - zero[1])
    value = F.when(F.col("v") > 0, F.col("value") + absent).otherwise(0)
    ways = F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("a", "b"), ("b", "a"))))
    out = whole.select("lang", value.cast("long").alias("value"), F.explode(ways).alias("way")).select("lang", "way.*", "value")
    return ranked(out, "pair")


def term_rows(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    found = kept.select("lang", "source", F.col("term").alias("item"), "n", "lang_n").join(groups, ["lang", "source"])
    value = share(F.col("n"), F.col("below")) - share(F.col("lang_n"), F.col("lang_sum") + PRIOR * F.col("v"))
    found = found.select("lang", "source", "item", value.cast("long").alias("value")).where("value > 0")
    return ranked(found, "term").where(F.col("rank") <= top)


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
