"""Token ids as files of Simple-8b blocks in document order.

``write`` range-partitions documents by id, so that the files follow each other in ascending order, encodes them with the
tokenizers library and appends an end id to each. A file is a Parquet file with a row per block of whole documents:
``part`` and ``block`` give its place, ``doc_ids`` and ``doc_counts`` its documents, ``words`` the Simple-8b words (little
endian), ``jumps`` the number of ids before every 128th word. ``read`` gives the ids of each document back, and their place
in the whole sequence from the counts of the blocks.

Defined results: a null text counts as empty and holds the end id alone; documents of equal or null id are ordered by a hash
of their text, null ids first; repeated rows are written each. A block ends with a document; one that is longer than a block
has a block of its own. Extra columns are left out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, islice
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm import simple8b
from parley.llm.bpe import folded
from parley.llm.common import documents, drop_long, in_arrow, make_room, pieces, slices

#: Ids after which a block ends.
BLOCK_IDS = 1 << 16
#: Words between two entries of ``jumps``.
JUMP = 128
#: Entries of each of the two caches of words: a miss costs a call of the library.
KEPT_WORDS = 700_000
#: Marks that are a word of their own after a letter: all of ASCII but the apostrophe, which may begin an ending.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)
FILES = (
    "part int, block int, n_ids long, doc_ids array<long>, doc_counts array<long>, words binary, jumps array<long>"
)
IDS = "part int, block int, before long, doc_id long, ids binary"


class Encoder:
    """The library's encoding, remembered by runs without white space: no token crosses it.

    Runs of letters are encoded together, as words of one text; the end-of-word mark tells their ids apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: set[bytes]) -> None:
        """Add runs that are not known yet: letters, letters before marks, and all others, which the library gets one by one."""
        make_room(self.known, len(chunks), KEPT_WORDS)
        plain, tailed, other = [], [], []
        for c in chunks:
            if c.decode().isalpha():
                plain.append(c)
            else:
                head = c.rstrip(MARKS)
                if len(head) < len(c) and head.decode().isalpha():
                    tailed.append((c, head, c[len(head) :]))
                else:
                    other.append(c)
        make_room(self.words, len(plain) + 2 * len(tailed), KEPT_WORDS)
        new = list({*plain, *(x for _, *both in tailed for x in both)}.difference(self.words))
        if new:
            ids = np.array(self._ids([b" ".join(new).decode()])[0], "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(new):
                flat, cuts = ids.tobytes(), (4 * ends).tolist()
                self.words.update(zip(new, map(flat.__getitem__, map(slice, [0, *cuts], cuts))))
            else:
                other, plain, tailed = list(chunks), [], []
        words = self.words
        self.known.update(zip(plain, map(words.__getitem__, plain)))
        self.known.update((c, words[head] + words[tail]) for c, head, tail in tailed)
        for c, ids in zip(other, self._ids([c.decode() for c in other])):
            self.known[c] = np.array(ids, "<u4").tobytes()
        drop_long(self.words, new)

    def encode_all(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text. Every run is looked up once; only those not found are learned and filled in."""
        runs, counts = [], []
        for t in texts:
            before = len(runs)
            for part in pieces(folded(t)) if t else ():
                runs += part.split()
            counts.append(len(runs) - before)
        found = list(map(self.known.get, runs))
        missed = list(compress(range(len(runs)), map(not_, found)))
        if missed:
            chunks = {runs[i] for i in missed}
            self.learn(chunks)
            for i in missed:
                found[i] = self.known[runs[i]]
            drop_long(self.known, chunks)
        each = iter(found)
        return [b"".join(islice(each, n)) for n in counts]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _block(part: int, number: int, docs: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    words = simple8b.pack(ids)
    row = {
        "part": part, "block": number, "n_ids": len(ids), "doc_ids": [d for d, _ in docs],
        "doc_counts": [len(x) // 4 for _, x in docs], "words": words.astype("<u8").tobytes(),
        "jumps": simple8b.offsets(words)[::JUMP].tolist(),
    }
    kinds = {"part": pa.int32(), "block": pa.int32(), "n_ids": pa.int64(), "words": pa.binary()}
    columns = [pa.array([v], kinds.get(k, pa.list_(pa.int64()))) for k, v in row.items()]
    return pa.record_batch(columns, list(row))


def blocks(docs: DataFrame, vocabulary: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The rows of the files; a block ends with the document that brings it to ``block_ids``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(vocabulary), TaskContext.get().partitionId()
        number, held, size = 0, [], 0
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for at, texts in slices(batch):
                for key, ids in zip(keys[at:], own.encode_all(texts)):
                    held.append((key, ids + end))
                    size += len(held[-1][1]) // 4
                    if size >= block_ids:
                        yield _block(part, number, held)
                        number, held, size = number + 1, [], 0
        if held:
            yield _block(part, number, held)

    order = ("doc_id", "tie")
    rows = documents(docs).withColumn("tie", F.xxhash64("text"))
    return in_arrow(rows.repartitionByRange(*order).sortWithinPartitions(*order), run, FILES)


def write(docs: DataFrame, vocabulary: str, end_id: int, folder: str, block_ids: int = BLOCK_IDS) -> None:
    """Write the files below a folder that all executors share."""
    blocks(docs, vocabulary, end_id, block_ids).write.option("compression", "zstd").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """part, block, doc_id, ids (little-endian unsigned 32-bit) and the ids before it in its block, of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                words = np.frombuffer(row["words"], "<u8").astype(np.uint64)
                flat = simple8b.unpack(words, row["n_ids"]).astype("<u4").tobytes()
                cuts = np.concatenate(([0], np.cumsum(row["doc_counts"]))).astype(np.int64).tolist()
                n = len(row["doc_ids"])
                yield pa.record_batch(
                    [
                        pa.array([row["part"]] * n, pa.int32()),
                        pa.array([row["block"]] * n, pa.int32()),
                        pa.array(cuts[:-1], pa.int64()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array([flat[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    ],
                    ["part", "block", "before", "doc_id", "ids"],
                )

    return in_arrow(spark.read.schema(FILES).parquet(folder), run, IDS)


def block_starts(spark: SparkSession, folder: str) -> DataFrame:
    """part, block and the number of ids before it in all files.

    Parts are summed first, so the one pass in order over everything has a row per file.
    """
    files = spark.read.schema(FILES).parquet(folder).select("part", "block", "n_ids")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("part", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inside"))
    return placed.join(parts, "part").select("part", "block", (F.col("ahead") + F.col("inside")).alias("block_start"))
