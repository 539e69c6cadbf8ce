"""A messages table derived from the benchmark tables (events, documents, pages).

One message per event. Its text is a whole document, a URL of a page, or a
fixed phrase, chosen by the event and user number, so that every analysis has
something to find: a raid text in a third of all messages, commands, mentions,
links, shouting and emotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASKS_PER_CORE = 2


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _joined(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(F.col("event_id").alias("n"), "ts", F.col("user_id").alias("u"))
    documents, pages = table(spark, folder, "documents"), table(spark, folder, "pages")
    doc_count = documents.agg(F.count("*")).scalar()
    page_count = pages.agg(F.count("*")).scalar()
    docs = documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("t"), "lang")
    # Narrow rows first: the long texts join last and are not shuffled again. Both sides are dealt by document over all cores,
    # or a table of one file would be joined, and read by every analysis after, in one task.
    rows = events.withColumn("page_id", F.col("n") % page_count).join(pages.select("page_id", "url"), "page_id")
    rows = rows.withColumn("doc_id", F.col("n") % doc_count).repartition(_parts(spark), "doc_id")
    return rows.join(docs.repartition(_parts(spark), "doc_id").hint("merge"), "doc_id")


def _parts(spark: SparkSession) -> int:
    """Partitions of the derived table at every size: ``TASKS_PER_CORE``, or as many as the session sets for shuffles."""
    return max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def messages(spark: SparkSession, folder: str, keep=()) -> DataFrame:
    """The derived messages table; ``keep`` adds columns such as ``lang``."""
    n, u, t = F.col("n"), F.col("u"), F.col("t")
    even = n % 2 == 0
    command = F.concat(F.lit("!"), F.when(n % 3 == 0, "stats").when(n % 3 == 1, "so").otherwise("Clip"))
    raid = n % 24 < 8
    emotes = ~raid & (u % 11 != 0) & ~(n % 7).isin(1, 2) & (n % 9 != 3) & (n % 13 == 4)
    text = (
        F.when(raid, "Raid incoming Kappa")
        .when(u % 22 == 0, command)
        .when(u % 11 == 0, F.concat(command, F.lit(" "), t))
        .when(n % 7 == 1, F.concat(F.lit("@User"), ((u * 7 + n) % 15).cast("string"), F.lit(" "), t))
        .when(n % 7 == 2, F.concat(t, F.lit(" "), F.col("url"), F.when(even, "!").otherwise("")))
        .when(n % 9 == 3, F.concat(F.lit("WHAT IS THIS "), (n % 3).cast("string"), F.lit("?")))
        .when(emotes, F.concat(F.when(even, "Kappa Keepo LUL ").otherwise("Kappa Keepo "), t))
        .otherwise(t)
    )
    emotes_tag = F.when(raid, "25:14-18").when(
        emotes, F.when(even, "25:0-4/1902:6-10/425618:12-14").otherwise("25:0-4/1902:6-10")
    )
    role = (
        F.when(u == 1, "broadcaster")
        .when(u % 10 == 0, "moderator")
        .when(u % 10 == 1, "vip")
        .when((u % 10).isin(2, 3), "subscriber")
        .otherwise("regular")
    )
    return _joined(spark, folder).select(
        F.concat(F.lit("m"), n.cast("string")).alias("id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        u.cast("string").alias("user_id"),
        F.concat(F.lit("User"), u.cast("string")).alias("username"),
        text.alias("text"),
        emotes_tag.alias("emotes_tag"),
        role.alias("role"),
        F.concat(F.lit("ch"), (u % 3).cast("string")).alias("channel"),
        *keep,
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The same messages as raw records, with tags; one event in 50 has no user id, one in 97 no readable time."""
    rows = messages(spark, folder, keep=("n", "u"))
    n, u = F.col("n"), F.col("u")
    text_or = lambda test, value: F.when(test, value).otherwise(F.lit(None).cast("string"))
    badge = F.when(F.col("role") == "regular", F.lit("premium/1")).otherwise(F.concat(F.lit("premium/1,"), "role", F.lit("/3")))
    tags = {
        "user-id": text_or(n % 50 != 0, F.col("user_id")),
        "emotes": F.col("emotes_tag"),
        "badges": badge,
        "room-id": F.when(n % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("room-"), (u % 3).cast("string"))),
        "reply-parent-msg-id": text_or(n % 6 == 0, F.concat(F.lit("m"), (n - 1).cast("string"))),
        "first-msg": F.when(n % 10 == 0, "1").otherwise("0"),
        "returning-chatter": F.when(n % 15 == 0, "1").otherwise("0"),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in tags.items()])
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zone = F.when(n % 3 == 0, "Z").when(n % 3 == 1, "+00:00").otherwise("")
    return rows.select(
        F.lit(1).alias("type"),
        "text",
        "username",
        F.col("username").alias("displayName"),
        F.when(n % 97 == 0, "not a time").otherwise(F.concat(stamp, zone)).alias("timestamp"),
        "id",
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("tags"),
        "channel",
        F.concat(F.lit(":"), "username", F.lit(" PRIVMSG #"), "channel").alias("raw"),
    )
