"""Words, vocabulary, commands and phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley import constants as C
from parley.functions import text as tx
from parley.functions.core import keys, partition, top_k
from parley.operators.emotes import emote_counts

#: Words of which a task counts the pairs at once, more only if one text has more.
PAIR_WORDS = 1 << 20


def word_counts(df: DataFrame, seen: DataFrame | None = None, by=(), stop=C.STOPWORDS) -> DataFrame:
    """Counts of the words of the cleaned text without stopwords.

    ``seen`` is a table of names (column ``name``) whose lower-cased form is
    ignored too. It depends on the data and may grow with it, so it meets the
    finished counts in an ordinary join instead of being broadcast.
    """
    by = keys(by)
    tokens = df.select(*by, F.explode(tx.words("text")).alias("word")).filter(~F.col("word").isin(*stop))
    counts = tokens.groupBy(*by, "word").agg(F.count("*").alias("uses"))
    if seen is None:
        return counts
    scope = [c for c in by if c in seen.columns]
    ignored = seen.select(*scope, F.lower("name").alias("word")).distinct()
    return counts.join(ignored, [*scope, "word"], "left_anti")


def words_apart(counts: DataFrame, catalog: DataFrame | None = None, by=(), stop=C.STOPWORDS) -> DataFrame:
    """Word counts without stopwords and without emotes, from the table of ``emotes.token_counts``."""
    by = keys(by)
    words = counts.filter((F.col("kind") == "word") & ~F.col("name").isin(*stop)).select(*by, F.col("name").alias("word"), "uses")
    seen = emote_counts(None, catalog, by, counts)
    return words.join(seen.select(*by, F.lower("name").alias("word")).distinct(), [*by, "word"], "left_anti")


def top_words(counts: DataFrame, n: int = 50, by=()) -> DataFrame:
    """The n most used words of a count table."""
    return top_k(counts, n, [F.desc("uses"), F.asc("word")], keys(by))


def vocabulary(counts: DataFrame, by=()) -> DataFrame:
    """Distinct words, type/token ratio and share of words used once."""
    by = keys(by)
    return counts.groupBy(*by).agg(
        F.count("*").alias("unique_word_count"),
        F.round(F.count("*") / F.sum("uses"), 4).alias("vocab_richness"),
        F.round(F.when(F.count("*") > 0, F.count_if(F.col("uses") == 1) / F.greatest(F.count("*"), F.lit(1))), 4).alias(
            "hapax_ratio"
        ),
    )


def zipf_slope(counts: DataFrame, by=()) -> DataFrame:
    """Slope of ln(count) over ln(rank) for the thousand most used words; null below ten words.

    The head of a thousand is part of the definition of this figure.
    """
    by = keys(by)
    head = top_words(counts, C.ZIPF_MAX_RANK, by)
    ranked = head.withColumn("rank", F.row_number().over(partition(by).orderBy(F.desc("uses"), F.asc("word"))))
    slope: Column = F.regr_slope(F.ln("uses"), F.ln("rank"))
    return ranked.groupBy(*by).agg(F.round(F.when(F.count("*") >= C.ZIPF_MIN_WORDS, slope), 4).alias("zipf_slope"))


def command_counts(df: DataFrame, by=()) -> DataFrame:
    """Uses and distinct users per command name."""
    by = keys(by)
    named = df.filter(F.startswith("text", F.lit("!"))).select(*by, "user_id", tx.command_name("text").alias("name"))
    return (
        named.filter(F.col("name").isNotNull())
        .groupBy(*by, "name")
        .agg(F.count("*").alias("uses"), F.count_distinct("user_id").alias("unique_users"))
    )


def top_commands(counts: DataFrame, n: int = 20, by=()) -> DataFrame:
    """The n most used commands."""
    return top_k(counts, n, [F.desc("uses"), F.asc("name")], keys(by))


def messages_with_commands(df: DataFrame, by=()) -> DataFrame:
    """Messages that start with ``!`` and a command name."""
    return df.groupBy(*keys(by)).agg(F.count_if(F.col("text").rlike(C.COMMAND_RE)).alias("messages_with_commands"))


def phrase_counts(df: DataFrame, by=()) -> DataFrame:
    """Uses per adjacent pair of words of the cleaned text, joined by a blank.

    Tasks number the words of a run of rows and count pairs of numbers, so a
    pair becomes text once per run of rows and not once per use.
    """
    by = keys(by)
    tokens = df.select(*by, tx.words("text").alias("tokens"))
    shape = T.StructType([*(tokens.schema[c] for c in by), T.StructField("phrase", T.StringType()), T.StructField("n", T.LongType())])
    fields, most = list(by), PAIR_WORDS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy().astype(np.int64)
            ends, at = np.cumsum(sizes), 0
            while at < batch.num_rows:
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
                yield from pairs(batch.slice(at, to - at), sizes[at:to])
                at = to

    def pairs(rows: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        numbered = rows.column("tokens").flatten().dictionary_encode()
        names, number = numbered.dictionary, numbered.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        inside = row[1:] == row[:-1]
        if not inside.any():
            return
        # a group is known by its first row
        found, first = {}, np.zeros(len(sizes), np.int64)
        for k, key in enumerate(zip(*(rows.column(c).to_pylist() for c in fields)) if fields else ()):
            first[k] = found.setdefault(key, k)
        pair = number[:-1][inside] * len(names) + number[1:][inside]
        group = first[row[:-1][inside]]
        for key in np.unique(group):
            each, n = np.unique(pair[group == key], return_counts=True)
            phrase = pc.binary_join_element_wise(names.take(pa.array(each // len(names))), names.take(pa.array(each % len(names))), " ")
            fixed = [rows.column(c).take(pa.array(np.full(len(each), key))) for c in fields]
            yield pa.record_batch([*fixed, phrase, pa.array(n.astype(np.int64))], [*fields, "phrase", "n"])

    return tokens.mapInArrow(count, shape).groupBy(*by, "phrase").agg(F.sum("n").alias("uses"))


def top_phrases(df: DataFrame, n: int = 20, by=()) -> DataFrame:
    """Adjacent word pairs of the cleaned text seen at least twice."""
    by = keys(by)
    counts = phrase_counts(df, by).filter(F.col("uses") >= 2)
    return top_k(counts, n, [F.desc("uses"), F.asc("phrase")], by)
