"""Small helpers shared by the operators: grouping keys, top-k, one-row results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keys(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def partition(by: Sequence[str]):
    """Window partition for the given keys; without keys a single small partition.

    Only used on tables whose size is bounded (days, value histograms, k rows).
    """
    return Window.partitionBy(*by) if by else Window.partitionBy()


def top_k(df: DataFrame, k: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows in ``order``, per group when ``by`` is given.

    Without keys this is a TakeOrdered; with keys the rank filter becomes a
    group limit on the map side, so a hot group never meets in one task whole.
    """
    if not by:
        return df.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def attach(left: DataFrame, right: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Add the columns of an aggregate to every row of ``left``.

    ``right`` has one row per key. Without keys it has a single row, which is
    read as a scalar subquery, so no join is planned at all.
    """
    if by:
        return left.join(right.select(*by, *cols), list(by), "left")
    value = right.select(F.struct(*cols)).scalar()
    return left.withColumn("__one", value).select(*left.columns, *[F.col(f"__one.{c}").alias(c) for c in cols])


def complete(table: DataFrame, groups: DataFrame, by: Sequence[str], zeros: Sequence[str] = ()) -> DataFrame:
    """A one-row-per-key table with a row for every key of ``groups``: zeros in the named columns, else null."""
    if not by:
        return table
    full = groups.select(*by).distinct().join(table, list(by), "left")
    return full.fillna(0, list(zeros)) if zeros else full


def spine(df: DataFrame, by: Sequence[str], name: str, size: int) -> DataFrame:
    """Rows 0..size-1, repeated for each key of ``df``."""
    if not by:
        return df.sparkSession.range(size, numPartitions=1).select(F.col("id").cast("int").alias(name))
    return df.select(*by).distinct().withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))


def time_cell(ts: Column | str, width: str) -> Column:
    """Start of the epoch-aligned time cell of the given width."""
    return F.window(ts, width).getField("start")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, fractions dropped. Free of the session time zone on TIMESTAMP_NTZ."""
    return (end - start).cast("bigint")
