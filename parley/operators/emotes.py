"""Emote counts, pairs, centrality, entropy and diversity."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley import constants as C
from parley.functions import text as tx
from parley.functions.core import keys, top_k
from parley.operators.activity import last_by_time

#: Distinct runs of texts, and bytes of texts, after which a task hands its counts on.
RUNS, RUN_BYTES = 200_000, 64 << 20


def native_counts(df: DataFrame, by=()) -> DataFrame:
    """Occurrences of the emotes named by the positional tags."""
    by = keys(by)
    used = df.filter(F.length("emotes_tag") > 0)
    names = used.select(*by, F.explode(tx.parse_emotes("emotes_tag", "text")).alias("name"))
    return names.groupBy(*by, "name").agg(F.count("*").alias("uses"))


def run_counts(df: DataFrame, by=()) -> DataFrame:
    """Uses (``n``) of each run of a text between two blanks, and of native emotes as runs that begin with a blank.

    Tasks count the runs of their own rows before they are shuffled, and hand
    on what they hold after ``RUNS`` distinct ones or ``RUN_BYTES`` of text.
    """
    by = keys(by)
    names = F.transform(tx.parse_emotes("emotes_tag", "text"), lambda name: F.concat(F.lit(" "), name).cast("binary"))
    rows = df.select(*by, F.col("text").cast("binary").alias("text"), F.when(F.length("emotes_tag") > 0, names).alias("names"))
    shape = T.StructType([*(rows.schema[c] for c in by), T.StructField("run", T.BinaryType()), T.StructField("n", T.LongType())])
    fields, most, most_bytes = list(by), RUNS, RUN_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, types = {}, 0, []

        def handed_on() -> Iterator[pa.RecordBatch]:
            for key, counts in held.items():
                fixed = [pa.array([k] * len(counts), t) for k, t in zip(key, types)]
                found = [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())]
                yield pa.record_batch([*fixed, *found], [*fields, "run", "n"])
            held.clear()

        for batch in batches:
            types = [batch.schema.field(c).type for c in fields]
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                groups = zip(*(part.column(c).to_pylist() for c in fields)) if fields else repeat((), part.num_rows)
                texts = defaultdict(list)
                for key, text, emotes in zip(groups, part.column("text").to_pylist(), part.column("names").to_pylist()):
                    if text is not None:
                        texts[key].append(text)
                        size += len(text)
                    if emotes:
                        held.setdefault(key, Counter()).update(emotes)
                for key, found in texts.items():
                    held.setdefault(key, Counter()).update(b" ".join(found).split(b" "))
                if size > most_bytes or sum(map(len, held.values())) > most:
                    yield from handed_on()
                    size = 0
        yield from handed_on()

    counted = rows.mapInArrow(count, shape).filter(F.length("run") > 0)
    return counted.groupBy(*by, F.col("run").cast("string").alias("run")).agg(F.sum("n").alias("n"))


def token_counts(df: DataFrame, by=()) -> DataFrame:
    """How often each token is a native emote, a token of the text and a word of the cleaned text: ``name``, ``kind``, ``uses``.

    No URL, mention, token or word crosses a blank, so runs between blanks are
    counted first, and the patterns read each distinct run once. The condition
    on the sum, always true, keeps it in the plan of every reader, so that all
    readers of one plan share the pass over the messages. Kept as a table, it
    serves emote counts and word counts together.
    """
    by = keys(by)

    def named(kind: str, names: Column) -> Column:
        return F.transform(names, lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name")))

    spoken = F.concat(named("token", tx.emote_tokens("run")), named("word", tx.words("run")))
    native = named("native", F.array(F.substr("run", F.lit(2))))
    kinds = F.when(F.startswith("run", F.lit(" ")), native).otherwise(spoken)
    found = run_counts(df, by).select(*by, "n", F.inline(kinds))
    return found.groupBy(*by, "name", "kind").agg(F.sum("n").alias("uses")).filter(F.col("uses") > 0)


def emote_counts(df: DataFrame, catalog: DataFrame | None = None, by=(), counts: DataFrame | None = None) -> DataFrame:
    """Native emotes plus catalog names found as tokens of the text.

    Names already seen as native emotes are not counted a second time from
    the text. Tokens are counted before they meet the catalog, so a token in
    a third of all messages is combined map-side first. ``counts`` is the
    table of ``token_counts`` where it is at hand.
    """
    by = keys(by)
    counts = token_counts(df, by) if counts is None else counts
    natives = counts.filter(F.col("kind") == "native").select(*by, "name", "uses")
    if catalog is None:
        return natives
    scope = [c for c in by if c in catalog.columns]
    known = catalog.select(*scope, "name").distinct()
    tokens = counts.filter(F.col("kind") == "token").select(*by, "name", "uses")
    listed = tokens.join(known, [*scope, "name"], "left_semi").join(natives, [*by, "name"], "left_anti")
    return natives.unionByName(listed.select(*by, "name", "uses"))


def top_emotes(df: DataFrame, catalog: DataFrame | None = None, n: int = 50, by=()) -> DataFrame:
    """The n most used emotes."""
    by = keys(by)
    return top_k(emote_counts(df, catalog, by), n, [F.desc("uses"), F.asc("name")], by)


def pair_counts(df: DataFrame, by=(), most: int | None = None) -> DataFrame:
    """Unordered emote pairs of single messages with their counts.

    ``most`` leaves out messages with more distinct emotes; ``messages_above`` counts them.
    """
    by = keys(by)
    used = df.filter(F.length("emotes_tag") > 0)
    kinds = F.array_sort(F.array_distinct(tx.parse_emotes("emotes_tag", "text")))
    pairs = used.select(*by, kinds.alias("names")).select(*by, F.inline(tx.name_pairs(F.col("names"), most)))
    return pairs.groupBy(*by, "emote1", "emote2").agg(F.count("*").alias("uses"))


def messages_above(df: DataFrame, most: int, by=()) -> DataFrame:
    """Messages that ``pair_counts`` with the same limit leaves out."""
    kinds = F.size(F.array_distinct(tx.parse_emotes("emotes_tag", "text")))
    return df.groupBy(*keys(by)).agg(F.count_if(kinds > most).alias("messages_left_out"))


def top_emote_pairs(pairs: DataFrame, n: int = 20, by=()) -> DataFrame:
    """The n most frequent pairs of a pair-count table."""
    by = keys(by)
    return top_k(pairs, n, [F.desc("uses"), F.asc("emote1"), F.asc("emote2")], by)


def emote_centrality(pairs: DataFrame, n: int = 20, by=()) -> DataFrame:
    """Distinct partners per emote, from a pair-count table (one row per pair)."""
    by = keys(by)
    ends = pairs.select(*by, F.explode(F.array("emote1", "emote2")).alias("emote"))
    degree = ends.groupBy(*by, "emote").agg(F.count("*").alias("distinct_co_occurrences"))
    return top_k(degree, n, [F.desc("distinct_co_occurrences"), F.asc("emote")], by)


def emote_entropy(native: DataFrame, by=()) -> DataFrame:
    """Shannon entropy in bits of a native-count table: log2(N) - sum(c*log2(c))/N."""
    by = keys(by)
    uses = F.col("uses")
    bits = F.log2(F.sum(uses)) - F.sum(uses * F.log2(uses)) / F.sum(uses)
    entropy = F.when(F.count("*") > 0, F.round(F.greatest(bits, F.lit(0.0)), 4))
    return native.groupBy(*by).agg(entropy.alias("emote_entropy"))


def emote_diversity(df: DataFrame, n: int = 20, by=()) -> DataFrame:
    """Users with at least five emote uses: uses, distinct emotes and their ratio."""
    by = keys(by)
    used = df.filter(F.length("emotes_tag") > 0)
    names = used.select(*by, "user_id", "username", "ts", F.explode(tx.parse_emotes("emotes_tag", "text")).alias("name"))
    logins = names.groupBy(*by, "user_id", "username", "name").agg(
        F.count("*").alias("uses"), F.max("ts").alias("last_ts")
    )
    users = logins.groupBy(*by, "user_id").agg(
        last_by_time("username").alias("username"),
        F.sum("uses").alias("total_emote_uses"),
        F.count_distinct("name").alias("unique_emotes"),
    )
    kept = users.filter(F.col("total_emote_uses") >= C.MIN_EMOTE_USES).withColumn(
        "diversity_ratio", F.round(F.col("unique_emotes") / F.col("total_emote_uses"), 4)
    )
    return top_k(kept, n, [F.desc("total_emote_uses"), F.asc("user_id")], by)
