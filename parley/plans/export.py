"""Exports of finished sections and of filtered messages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.plans.bundle import as_document

CRLF = "\r\n"
# Sections of the CSV export and their columns.
CSV_SECTIONS = {
    "top_chatters": ("user_id", "username", "message_count", "active_days", "first_seen", "last_seen"),
    "top_words": ("word", "uses"),
    "top_emotes": ("name", "uses"),
    "emote_pairs": ("emote1", "emote2", "uses"),
    "top_commands": ("name", "uses", "unique_users"),
    "top_domains": ("domain", "uses"),
    "top_urls": ("url", "uses"),
    "top_mentions": ("username", "uses"),
    "per_day": ("day", "messages"),
    "roles": ("role", "messages", "unique_users"),
    "staff_list": ("user_id", "username", "role", "message_count", "first_seen", "last_seen"),
    "subscriber_list": ("user_id", "username", "message_count", "first_seen", "last_seen"),
    "anomalies": ("window_start", "message_count", "z_score", "p_value"),
}


def base_name(channel: str, start, end) -> str:
    """``channel_from_to`` with a name that is safe on every file system."""
    return f"{re.sub(r'[^A-Za-z0-9_-]', '_', channel)}_{str(start)[:10]}_{str(end)[:10]}"


def write_json(sections: dict[str, DataFrame], path: str) -> None:
    """All sections as JSON lines of (section, row)."""
    as_document(sections).write.mode("overwrite").json(path)


def _flat(table: DataFrame) -> DataFrame:
    """Timestamps as ISO text and arrays joined, as CSV has neither."""
    out = []
    for name, kind in table.dtypes:
        if kind.startswith("timestamp"):
            out.append(tx.iso_ts(name).alias(name))
        elif kind.startswith("array"):
            out.append(F.array_join(name, " ").alias(name))
        else:
            out.append(F.col(name))
    return table.select(*out)


#: Columns that order a section, those that count downwards.
_COUNTS = ("message_count", "uses")


def csv_lines(table: DataFrame) -> DataFrame:
    """A column ``line`` of RFC 4180 records after the other columns: quotes only where a comma, quote or line break asks for them."""
    flat = _flat(table)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in flat.columns]
    quoted = [F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]
    return flat.select("*", F.concat_ws(",", *quoted).alias("line"))


def write_csv(table: DataFrame, path: str) -> None:
    """One table as CSV files: header, quotes only where needed and doubled inside, lines that end with CR and LF."""
    writer = _flat(table).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", False)
    writer.option("emptyValue", "").option("lineSep", CRLF).csv(path)


def write_sections(sections: dict[str, DataFrame], root: str, base: str = "") -> list[str]:
    """Every exportable section that was computed, in one pass: a folder ``section=<base_>name`` with one CSV file each.

    The sections are reports of bounded size, so each is put in order in one task: counts downwards, then by its first columns.
    """
    rows, written = [], []
    for name, columns in CSV_SECTIONS.items():
        if name not in sections:
            continue
        table = csv_lines(sections[name].select(*columns))
        order = [F.desc(c) for c in columns if c in _COUNTS] + [F.asc(c) for c in columns if c not in _COUNTS]
        place = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order))
        header = table.sparkSession.range(1).select(F.lit(0).alias("place"), F.lit(",".join(columns)).alias("line"))
        full = header.unionByName(table.select(place.alias("place"), "line"))
        rows.append(full.withColumn("section", F.lit(f"{base}_{name}" if base else name)))
        written.append(name)
    if rows:
        lines = reduce(DataFrame.unionByName, rows).repartition(len(rows), "section").sortWithinPartitions("section", "place")
        lines.select("section", "line").write.mode("overwrite").option("lineSep", CRLF).partitionBy("section").text(root.rstrip("/"))
    return written


def read_section(spark: SparkSession, root: str, name: str, base: str = "") -> DataFrame:
    """A section that ``write_sections`` has written, all columns as text."""
    shape = ", ".join(f"{c} string" for c in CSV_SECTIONS[name])
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("emptyValue", "")
    return reader.schema(shape).csv(f"{root.rstrip('/')}/section={f'{base}_{name}' if base else name}")


def summary_text(sections: dict[str, DataFrame], channel: str, start, end) -> DataFrame:
    """The headline lines as one text: totals, top chatter, top emote, peak."""
    one = sections["overview"].select("total_messages", "unique_chatters", "days_spanned")
    first = lambda name, *order: sections[name].orderBy(*order).limit(1)
    chatter = first("top_chatters", F.desc("message_count"), F.asc("user_id"))
    emote = first("top_emotes", F.desc("uses"), F.asc("name"))
    number = lambda c: F.format_number(c, 0)
    lines = one.withColumns(
        {
            "chatter": chatter.select(F.concat(F.lit("Top chatter: "), "username", F.lit(" ("), number("message_count"), F.lit(")"))).scalar(),
            "emote": emote.select(F.concat(F.lit("Top emote: "), "name", F.lit(" ("), number("uses"), F.lit(")"))).scalar(),
            "peak": sections["peak_concurrency"]
            .select(F.concat(F.lit("Peak concurrent: "), F.col("peak_concurrent_chatters").cast("string"), F.lit(" (5m window)")))
            .scalar(),
        }
    )
    title = F.lit(f"**{channel}** — {str(start)[:10]} → {str(end)[:10]}")
    totals = F.concat(
        number("total_messages"), F.lit(" messages · "), number("unique_chatters"), F.lit(" chatters · "),
        F.col("days_spanned").cast("string"), F.lit(" days"),
    )
    return lines.select(F.concat_ws("\n", title, totals, "chatter", "emote", "peak").alias("summary"))


def message_lines(messages: DataFrame) -> DataFrame:
    """Messages as ``[time] name: text`` lines."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return messages.select(F.concat(F.lit("["), stamp, F.lit("] "), "username", F.lit(": "), "text").alias("value"))


def export_messages(messages: DataFrame, path: str, as_text: bool = False) -> None:
    """Filtered messages as JSON lines, or as text lines. Files follow the partitions; nothing is sorted whole."""
    if as_text:
        message_lines(messages).write.mode("overwrite").text(path)
    else:
        messages.write.mode("overwrite").json(path)
