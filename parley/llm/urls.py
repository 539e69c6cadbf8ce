"""URL filters: host-suffix and path-prefix expressions met with a rule list through short hash prefixes.

Every url is expanded into expressions, a suffix of its host followed by a prefix of its path, of the shapes (host labels, length
of the path) that occur in the rules, and into itself. Expressions and rules meet in an equi-join on the first ``PREFIX`` hex
digits of their SHA-256; a pair counts if the whole digests agree, and the longest rule of a row wins. DataFrame functions only.

A row of the expressions has no more than one entry for each shape of the rules, however long the url. A host or rule that a third
of all urls share is one join key; it is dealt into ``SALTS`` parts, and a rule is repeated that often. Whether the rules are
broadcast is left to Spark's check of their size.

Defined cases: a null url, or one without ``://``, has an empty host and path; it fits no rule unless one has an empty host. Repeated rows give
repeated results. Of rules for the same host and path, or equally long ones, a block wins. Rules without a slash hold for all
paths, null rules for nothing. A url that no rule fits gets ``default``. Other columns of either table, under any name, stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a hash prefix: 32 bits.
PREFIX = 8
#: Parts that a join key is dealt into.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path of a url; both empty where there is no ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(rules: DataFrame) -> DataFrame:
    """One row for each host and path of the rules, with its shape and digest."""
    text = F.col("`rule`").cast("string")
    host = F.translate(F.regexp_extract(text, "^[^/]*", 0), UPPER, LOWER)
    parts = rules.select(
        host.alias("rule_host"), F.regexp_extract(text, "(?s)/.*$", 0).alias("rule_path"), F.col("`verdict`").cast("string").alias("verdict")
    )
    return (
        parts.where(F.col("rule_host").isNotNull())
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("verdict"))  # block comes after allow
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("digest", F.sha2(F.col("rule").cast("binary"), 256))
    )


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """The key, host, path, rule and verdict of every row of ``pages``.

    ``rules`` has the columns ``verdict`` (allow or block) and ``rule`` (a host followed by the start of a path).
    """
    listed = rule_table(rules)
    shape = F.struct(F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("length"))
    shapes = listed.select(F.collect_set(shape)).scalar()

    host, path = host_and_path(F.col("url"))
    rows = (
        pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"))
        .withColumn("part", F.spark_partition_id())
        .select("key", "part", host.alias("host"), path.alias("path"), shapes.alias("shapes"))
    )
    # Equal rows of one partition are told by their number: each has one expression that is the url itself.
    itself = F.struct(F.lit(True).alias("whole"), F.concat("host", "path").alias("text"))
    fitting = F.filter("shapes", lambda s: F.length("path") >= s["length"])
    cut = F.transform(
        fitting,
        lambda s: F.struct(
            F.lit(False).alias("whole"),
            F.concat(F.call_function("substring_index", "host", F.lit("."), -s["labels"]), F.left("path", s["length"])).alias("text"),
        ),
    )
    digest = F.sha2(F.col("text").cast("binary"), 256)
    expressions = (
        rows.select("key", "part", "host", "path", F.inline(F.concat(F.array(itself), cut)))
        .select("key", "part", "host", "path", "whole", digest.alias("digest"))
        .withColumn("prefix", F.left("digest", F.lit(PREFIX)))
        .withColumn("salt", F.pmod(F.xxhash64("key", "part", "host", "path"), F.lit(SALTS)).cast("int"))
    )
    hit = F.struct(F.length("rule").alias("length"), F.length("rule_host").alias("host_length"), "verdict", "rule", "digest")
    marked = (
        listed.groupBy(F.left("digest", F.lit(PREFIX)).alias("prefix"))
        .agg(F.collect_list(hit).alias("candidates"))
        .withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    )
    met = expressions.join(marked, ["prefix", "salt"], "left")
    confirmed = F.get(F.filter("candidates", lambda c: c["digest"] == F.col("digest")), F.lit(0))
    best = met.groupBy("key", "part", "host", "path").agg(F.count_if("whole").alias("copies"), F.max(confirmed).alias("hit"))
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(
        F.col("key").alias(key),
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.lit(default)).alias("verdict"),
    )
