"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced together.

Rows of equal text are a group and stay together, unless a group is more than ``WHOLE`` of a shard: then it is dealt by id into
pieces below that, as no shard could stay near the others with it. A group goes to the shard for which the dot product of
its vector with the residual capacity is highest, larger groups first. Groups above a fixed share of a shard, of which there can
be ``shards * LARGE`` at most, are placed first in one task. The rest is dealt into cells of about ``CELL`` groups that are
packed at the same time, each against its share of what the large groups have left of every shard, so no task sees all.

Law: ``bytes``. The sizes of the shards are near equal; rows and tokens follow as far as the groups allow.

Defined results: a null text has the size of its overhead, the checksum of an empty text, and all null texts are one group; an
empty text is another; repeated rows are placed each; null ids are placed like any; extra columns are left out. Slots
number the rows of a shard from 0 without gaps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import documents, ship, written

#: Bytes of a row besides its text.
OVERHEAD = 16
#: The share of a shard up to which a group stays whole.
WHOLE = 0.25
#: Groups above 1 / LARGE of a shard are placed before the others.
LARGE = 256
#: Groups in a cell, about.
CELL = 20_000
#: Rows that are numbered in one task, about.
SLOTS = 200_000
#: What bytes, tokens and rows count for in the dot product; bytes are the law.
WEIGHTS = (1.0, 0.01, 0.01)
PLACED = "unit binary, piece int, shard int, bytes long, tokens long, rows long"


def pack(sizes: np.ndarray, capacity: np.ndarray, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of each group; ``sizes`` is groups by dimensions, ``capacity`` shards by dimensions.

    Both are taken relative to the whole capacity of a dimension, so that the dimensions compare.
    """
    whole = np.maximum(capacity.sum(axis=0), 1e-9)
    weight = np.array(weights)
    left = capacity / whole
    out = np.zeros(len(sizes), np.int32)
    relative = sizes / whole
    for i in np.lexsort((np.arange(len(sizes)), -sizes[:, 0])):
        v = relative[i]
        best = int(np.argmax(left @ (v * weight)))
        out[i] = best
        left[best] -= v
    return out


def _packed(table: pa.Table, capacity: np.ndarray, weights: tuple[float, ...]) -> pa.Table:
    order = table.sort_by([("bytes", "descending"), ("unit", "ascending"), ("piece", "ascending")])
    sizes = np.stack([order.column(c).to_numpy().astype(float) for c in ("bytes", "tokens", "rows")], axis=1)
    shard = pa.array(pack(sizes, capacity, weights), pa.int32())
    return order.select(["unit", "piece"]).append_column("shard", shard).append_column("bytes", order["bytes"]).append_column(
        "tokens", order["tokens"]
    ).append_column("rows", order["rows"])


def shard(docs: DataFrame, shards: int, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and tokens of each document; ``weights`` are those of bytes, tokens and rows."""
    ship(docs.sparkSession)
    text = F.col("text")
    plain = F.coalesce(text, F.lit(""))
    rows = documents(docs).select(
        "doc_id",
        (F.octet_length(plain) + OVERHEAD).cast("long").alias("size"),
        F.regexp_count(plain, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.crc32(plain.cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"")).alias("unit"),
    )
    rows = written(rows, "sizes")
    total = rows.agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).first()
    each = max(1.0, (total["bytes"] or 0) / shards)
    figures = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    pieces = F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(WHOLE * each))).cast("int")
    split = rows.groupBy("unit").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > WHOLE * each)
    split = split.select("unit", pieces.alias("pieces"))  # fewer than shards / WHOLE groups
    rows = rows.join(F.broadcast(split), "unit", "left")
    piece = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.coalesce("pieces", F.lit(1))).cast("int")
    rows = written(rows.withColumn("piece", piece).drop("pieces"), "rows")
    units = written(rows.groupBy("unit", "piece").agg(*figures), "units")
    capacity = np.array([[float(x or 0) / shards for x in total]] * shards)

    def place_large(table: pa.Table) -> pa.Table:
        return _packed(table, capacity, weights)

    large = units.where(F.col("bytes") > each / LARGE)
    large = written(large.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(place_large, PLACED), "large")
    for row in large.groupBy("shard").agg(*(F.sum(c).alias(c) for c in ("bytes", "tokens", "rows"))).collect():  # one per shard
        capacity[row["shard"]] -= [float(row[c]) for c in ("bytes", "tokens", "rows")]
    room = np.maximum(capacity, 0)

    def place_cell(table: pa.Table) -> pa.Table:
        own = np.array([float(sum(table.column(c).to_pylist())) for c in ("bytes", "tokens", "rows")])
        return _packed(table, room / np.maximum(room.sum(axis=0), 1e-9) * own, weights)

    small = units.where(F.col("bytes") <= each / LARGE)
    cells = max(1, -(-small.count() // CELL))
    cell = F.pmod(F.xxhash64("unit", "piece"), F.lit(cells))
    placed = small.withColumn("cell", cell).groupBy("cell").applyInArrow(place_cell, PLACED).unionByName(large).select("unit", "piece", "shard")
    found = written(rows.join(placed, ["unit", "piece"]), "placed")
    parts = max(1, -(-total["rows"] // (SLOTS * shards)))
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "unit"), F.lit(parts)))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "unit")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = found.groupBy("shard", "part").agg(F.count("*").alias("n"))
    firsts = firsts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = found.withColumn("place", F.row_number().over(within)).join(firsts, ["shard", "part"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )
