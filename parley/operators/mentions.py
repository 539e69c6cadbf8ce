"""Mention edges, degrees, mutual mentions and inferred replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley import constants as C
from parley.functions import text as tx
from parley.functions.core import keys, seconds_between, time_cell, top_k


#: Seconds of a cell of the search for replies, at most.
CELL_S = 900


def mention_edges(df: DataFrame, by=()) -> DataFrame:
    """One row per mention of somebody else: who, whom, when."""
    by = keys(by)
    named = df.filter(tx.has_mention("text"))
    edges = named.select(
        *by, "ts", F.lower("username").alias("from_user"), F.explode(tx.mentions("text")).alias("to_user")
    )
    return edges.filter(F.col("from_user") != F.col("to_user"))


def edge_counts(df: DataFrame, by=()) -> DataFrame:
    """Mentions per (from, to), the weighted edge table the graph reports read."""
    by = keys(by)
    return mention_edges(df, by).groupBy(*by, "from_user", "to_user").agg(F.count("*").alias("uses"))


def messages_with_mentions(df: DataFrame, by=()) -> DataFrame:
    """Messages with any mention, of oneself included."""
    return df.groupBy(*keys(by)).agg(F.count_if(tx.has_mention("text")).alias("messages_with_mentions"))


def top_mentions(edges: DataFrame, n: int = 20, by=()) -> DataFrame:
    """The n most mentioned users."""
    by = keys(by)
    counts = edges.groupBy(*by, F.col("to_user").alias("username")).agg(F.sum("uses").alias("uses"))
    return top_k(counts, n, [F.desc("uses"), F.asc("username")], by)


def top_mention_pairs(edges: DataFrame, n: int = 20, by=()) -> DataFrame:
    """The n most frequent (from, to) pairs."""
    return top_k(edges, n, [F.desc("uses"), F.asc("from_user"), F.asc("to_user")], keys(by))


def mention_graph(edges: DataFrame, n: int = 20, by=()) -> DataFrame:
    """In, out and total degree: both ends of an edge stacked, then one aggregate."""
    by = keys(by)
    zero = F.lit(0).cast("bigint")
    ends = F.array(
        F.struct(F.col("from_user").alias("username"), zero.alias("i"), F.col("uses").alias("o")),
        F.struct(F.col("to_user").alias("username"), F.col("uses").alias("i"), zero.alias("o")),
    )
    degrees = (
        edges.select(*by, F.inline(ends))
        .groupBy(*by, "username")
        .agg(F.sum("i").alias("mentions_in"), F.sum("o").alias("mentions_out"))
        .withColumn("degree", F.col("mentions_in") + F.col("mentions_out"))
    )
    return top_k(degrees, n, [F.desc("degree"), F.asc("username")], by)


def mutual_mentions(edges: DataFrame, n: int = 20, by=()) -> DataFrame:
    """Pairs that mention each other, found by grouping both directions on the unordered pair."""
    by = keys(by)
    forward = F.col("from_user") < F.col("to_user")
    pairs = edges.groupBy(
        *by,
        F.least("from_user", "to_user").alias("user_a"),
        F.greatest("from_user", "to_user").alias("user_b"),
    ).agg(
        F.sum(F.when(forward, F.col("uses")).otherwise(0)).alias("count_ab"),
        F.sum(F.when(forward, F.lit(0)).otherwise(F.col("uses"))).alias("count_ba"),
    )
    both = pairs.filter((F.col("count_ab") > 0) & (F.col("count_ba") > 0))
    both = both.withColumn("total", F.col("count_ab") + F.col("count_ba"))
    return top_k(both, n, [F.desc("total"), F.asc("user_a"), F.asc("user_b")], by)


def replies(df: DataFrame, by=(), window_s: int = C.REPLY_WINDOW_S) -> DataFrame:
    """Mentions of somebody whose latest message at or before the mention is recent.

    An as-of join with a tolerance. Only messages of mentioned users take part.
    Time is cut into cells of at most ``CELL_S`` seconds; the last message of
    each (user, cell) is carried into as many later cells as the tolerance
    reaches, so the wanted message is always in the cell of the mention. The
    search then runs inside (user, cell) groups, which splits a user who
    wrote, or is mentioned in, a third of all messages by time.
    """
    by = keys(by)
    width = min(window_s + 1, CELL_S)
    reach = -(-(window_s + 1) // width)
    cell = time_cell("ts", f"{width} seconds")
    mentions = mention_edges(df, by).select(
        *by, F.col("to_user").alias("target"), cell.alias("cell"), "ts", F.lit(1).alias("side"), "from_user"
    )
    own = df.select(*by, F.lower("username").alias("target"), cell.alias("cell"), "ts")
    own = own.join(mentions.select(*by, "target").distinct(), [*by, "target"], "left_semi")
    carried = own.groupBy(*by, "target", "cell").agg(F.max("ts").alias("ts"))
    later = F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("k")
    carried = carried.select(*by, "target", "cell", "ts", later)
    carried = carried.withColumn("cell", F.timestamp_add("SECOND", F.col("k") * width, F.col("cell"))).drop("k")
    targets = own.unionByName(carried).withColumn("side", F.lit(0)).withColumn("from_user", F.lit(None).cast("string"))
    upto = (
        Window.partitionBy(*by, "target", "cell")
        .orderBy("ts", "side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    latest = F.last(F.when(F.col("side") == 0, F.col("ts")), ignorenulls=True).over(upto)
    found = mentions.unionByName(targets).withColumn("ts_target", latest).filter(F.col("side") == 1)
    return found.filter(seconds_between(F.col("ts_target"), F.col("ts")) <= window_s).select(
        *by, "from_user", F.col("target").alias("to_user"), F.col("ts").alias("ts_reply"), "ts_target"
    )


def reply_counts(df: DataFrame, by=()) -> DataFrame:
    """Replies per (from, to)."""
    by = keys(by)
    return replies(df, by).groupBy(*by, "from_user", "to_user").agg(F.count("*").alias("uses"))


def quote_reply_count(counts: DataFrame, by=()) -> DataFrame:
    """All replies."""
    return counts.groupBy(*keys(by)).agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("quote_reply_count"))


def quote_reply_pairs(counts: DataFrame, n: int = C.REPLY_TOP_N, by=()) -> DataFrame:
    """The n most frequent (from, to) replies."""
    return top_k(counts, n, [F.desc("uses"), F.asc("from_user"), F.asc("to_user")], keys(by))
