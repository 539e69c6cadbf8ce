"""URLs, domains and link platforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley import constants as C
from parley.functions import text as tx
from parley.functions.core import keys, top_k


def url_counts(df: DataFrame, by=()) -> DataFrame:
    """Occurrences per normalised URL; the table every other link report reads."""
    by = keys(by)
    found = df.filter(tx.has_url("text")).select(*by, F.explode(tx.urls("text")).alias("raw"))
    linked = found.select(*by, tx.bare_url(F.col("raw")).alias("bare")).filter(F.length("bare") > 0)
    return linked.groupBy(*by, tx.fold_host(F.col("bare")).alias("url")).agg(F.count("*").alias("uses"))


def messages_with_links(df: DataFrame, by=()) -> DataFrame:
    return df.groupBy(*keys(by)).agg(F.count_if(tx.has_url("text")).alias("messages_with_links"))


def top_urls(counts: DataFrame, n: int = 20, by=()) -> DataFrame:
    """The n most pasted URLs; the count table itself is the whole list."""
    return top_k(counts, n, [F.desc("uses"), F.asc("url")], keys(by))


def unique_urls(counts: DataFrame, by=()) -> DataFrame:
    """Number of distinct URLs, beside a capped list."""
    return counts.groupBy(*keys(by)).agg(F.count("*").alias("unique_url_count"))


def top_domains(counts: DataFrame, n: int = 20, by=()) -> DataFrame:
    """The n most linked domains."""
    by = keys(by)
    hosts = counts.select(*by, tx.domain_of(F.col("url")).alias("domain"), "uses").filter(F.col("domain").isNotNull())
    domains = hosts.groupBy(*by, "domain").agg(F.sum("uses").alias("uses"))
    return top_k(domains, n, [F.desc("uses"), F.asc("domain")], by)


def platform_links(counts: DataFrame, by=(), strict: bool = False) -> DataFrame:
    """URL occurrences per platform, and of no platform.

    The usual rules look for a substring of the URL; ``strict`` compares the
    host instead, so that netflix.com is no longer taken for x.com.
    """
    by = keys(by)
    url = F.lower("url")
    if strict:
        host = F.regexp_replace(tx.domain_of(url), r"[:?#].*$", "")
        on = {name: host.rlike(rule) for name, rule in C.PLATFORM_HOSTS.items()}
    else:
        on = {name: url.rlike(rule) for name, rule in C.PLATFORM_RES.items()}
    on["other"] = ~reduce(lambda a, b: a | b, on.values())
    return counts.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(test, F.col("uses"))), F.lit(0)).alias(name) for name, test in on.items()]
    )
