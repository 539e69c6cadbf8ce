"""Emote catalogs from saved provider payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# JSON shapes of the three providers' answers.
SEVENTV = "emote_set struct<emotes: array<struct<id: string, name: string>>>"
BTTV = "channelEmotes array<struct<id: string, code: string>>, sharedEmotes array<struct<id: string, code: string>>"
FFZ = "sets map<string, struct<emoticons: array<struct<id: string, name: string>>>>"

# On equal emote ids the later provider wins.
PROVIDERS = ("7tv", "bttv", "ffz")


def _pairs(payload: Column, provider: str) -> Column:
    """Array of (emote_id, name) of one payload."""
    empty = F.array().cast("array<struct<id: string, name: string>>")

    def listed(items: Column) -> Column:
        return F.coalesce(items, empty)

    if provider == "7tv":
        return listed(F.from_json(payload, SEVENTV)["emote_set"]["emotes"])
    if provider == "bttv":
        doc = F.from_json(payload, BTTV)
        renamed = [listed(doc[k].cast("array<struct<id: string, name: string>>")) for k in ("channelEmotes", "sharedEmotes")]
        return F.concat(*renamed)
    sets = F.map_values(F.from_json(payload, FFZ)["sets"])
    return listed(F.flatten(F.transform(sets, lambda s: listed(s["emoticons"]))))


def emote_catalog(payloads: DataFrame) -> DataFrame:
    """``channel, provider, payload`` (JSON text) to one name per channel and emote id."""
    place, entries = F.lit(None).cast("int"), F.array().cast("array<struct<id: string, name: string>>")
    for i, provider in enumerate(PROVIDERS):
        mine = F.col("provider") == provider
        place = F.when(mine, F.lit(i)).otherwise(place)
        entries = F.when(mine, _pairs(F.col("payload"), provider)).otherwise(entries)
    rows = payloads.select("channel", "provider", place.alias("place"), F.posexplode(entries).alias("pos", "e"))
    rows = rows.filter(F.col("e.id").isNotNull() & F.col("e.name").isNotNull())
    best = F.max(F.struct("place", "pos", "provider", F.col("e.name").alias("name")))
    return (
        rows.groupBy("channel", F.col("e.id").alias("emote_id"))
        .agg(best.alias("best"))
        .select("channel", F.col("best.provider").alias("provider"), "emote_id", F.col("best.name").alias("name"))
    )


def read_payloads(spark, path: str, channel: str, provider: str) -> DataFrame:
    """Payload files of one provider, one JSON document per file."""
    return spark.read.text(path, wholetext=True).select(
        F.lit(channel).alias("channel"), F.lit(provider).alias("provider"), F.col("value").alias("payload")
    )


def catalog_union(catalog: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One catalog for several channels; a channel later in the list wins on equal ids."""
    order = F.array_position(F.array(*[F.lit(c) for c in channels]), F.col("channel"))
    rows = catalog.filter(F.col("channel").isin(*channels)).withColumn("place", order)
    return rows.groupBy("emote_id").agg(F.max(F.struct("place", "name")).getField("name").alias("name"))
